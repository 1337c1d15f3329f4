"""Spelling variants, licence scans and conversation tries against plain versions on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratawork.llm import license_scan, prefix_trie, spelling
from stratawork.llm.queries import QUERIES
from stratawork.llm.text import read

DOCS = "text string, word string, doc_id long, n int, row int, words string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(text, "x", doc_id, 1, 2, "y") for doc_id, text in rows], DOCS)


# Spelling ------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def test_spelling_groups_equal_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(250)}
    words |= {"aaaaaa" + "b" * k for k in range(4)} | {"Ä" * 6, "ä" * 6, "x" * 3000, "x" * 3001}
    counts = {w: rng.choice([5, 6, 25, 30, 200, 1000, 5000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.spelling_groups(table).collect()
    assert {tuple(r) for r in got} == plain_groups(counts)
    assert len(got) == len(counts) and any(r.root not in (r.word, r.form) for r in got)


def test_word_counts_of_odd_documents(spark):
    rng = random.Random(6)
    vocabulary = ["Straße", "straße", "licence", "LICENSE", "ÉTÉÉTÉ", "étéété", "short", "a×b÷cdef", "naïvely", "colours"]
    rows = [(k % 300, " ".join(rng.choices(vocabulary, k=20))) for k in range(400)]
    rows += [(None, "licence licence"), (1, None), (2, ""), (3, "1234 -- "), rows[0], rows[0], (7, "word-splits don't matter " * 50_000)]
    rows += [(8, "abcdefg" * 200_000)] * 5  # one run longer than a piece
    got = {r.word: r.n for r in spelling.word_counts(docs_of(spark, rows)).collect()}
    assert got == plain_counts(rows)
    assert "colour" in got or any(len(w) == 6 for w in got)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(spelling.word_counts(docs_of(spark, []))).count() == 0
    assert spelling.spelling_groups(spelling.word_counts(docs_of(spark, [(1, None), (2, "too short")]))).count() == 0


# Licences ------------------------------------------------------------------------------------------------------------


def plain_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_base(text):
    words = plain_words(text)
    found = [
        (at, label)
        for label, phrase in license_scan.PHRASES
        for at in range(len(words))
        if words[at : at + len(phrase.split())] == phrase.split()
    ]
    starts = [at for at, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


NOTICE = license_scan.NOTICES[11][1]


def report(spark, rows):
    return license_scan.license_report(docs_of(spark, rows), license_scan.default_templates(spark))


def test_base_phrases_equal_a_plain_search(spark):
    rng = random.Random(7)
    vocabulary = "gnu general public license apache cc by mit GNU Licenſe K CC-BY the and 4.0".split()
    rows = [(k, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(300)]
    rows += [(None, "MIT License"), (None, "MIT License"), (5, None), (5, ""), (6, "mít license"), (7, "mit license")]
    got = report(spark, rows).collect()
    wanted = Counter((doc_id, *plain_base(text)) for doc_id, text in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == wanted
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)


def test_notices_survive_edits_and_clean_texts_have_none(spark):
    words = NOTICE.split()
    inserted = words[:9] + ["really", "quite"] + words[9:]
    lost = words[:7] + words[9:]
    replaced = words[:12] + ["good"] + words[13:]
    shuffled = list(words)
    random.Random(1).shuffle(shuffled)
    texts = [
        "before " * 50 + NOTICE.upper() + " after" * 20, " ".join(inserted), " ".join(lost), " ".join(replaced),
        " ".join(shuffled), " ".join(words[:8]), "the software and the license of the file in the form", (NOTICE + "\n") * 3,
    ]
    spans = {}
    rows, found = license_scan.license_spans(docs_of(spark, list(enumerate(texts))), license_scan.default_templates(spark))
    for r in found.join(rows, "row").collect():
        spans.setdefault(r.doc_id, []).append((r.label, r.first_word, r.last_word, r.n_found))
    n = len(plain_words(NOTICE))
    assert spans[0] == [("mit", 50, 49 + n, n)]
    assert spans[1] == [("mit", 0, n + 1, n)]
    assert spans[2][0][0] == spans[3][0][0] == "mit"
    assert not {4, 5, 6} & set(spans)
    assert sorted(s[1] for s in spans[7]) == [0, n, 2 * n]


def test_templates_of_every_length_and_odd_tables(spark):
    templates = spark.createDataFrame(
        [(1, "one", True, "Apache"), (2, "twice", True, "a b a b"), (3, "none", True, "--"), (4, "null", False, None)],
        "template int, label string, phrase boolean, text string",
    )
    got = license_scan.license_report(docs_of(spark, [(1, "apache a b a b a b"), (2, "x")]), templates).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.labels, r.score) for r in got] == [
        (3, 0, 3, "one,twice", 1.0), (0, None, None, "", 0.0),
    ]
    assert report(spark, []).count() == 0
    nothing = license_scan.license_report(docs_of(spark, [(1, "mit license")]), templates.limit(0)).first()
    assert (nothing.doc_id, nothing.n_words, nothing.n_base, nothing.score) == (1, 2, 0, 0.0)


def test_license_scan_of_a_text_of_some_megabytes(spark):
    got = report(spark, [(1, "word " * 600_000 + "Released under the MIT License. " + "word " * 200_000)]).first()
    assert (got.n_words, got.n_base, got.first_word, got.labels) == (800_005, 1, 600_003, "mit")


def test_license_scan_has_no_python_on_its_way(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    plan = license_scan.license_report(docs, license_scan.default_templates(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Tries ---------------------------------------------------------------------------------------------------------------


def test_closing_parentheses_equal_a_stack():
    rng = random.Random(8)
    for size in (1, 2, 40, 700, 5000):
        for steep in (0.5, 0.9, 0.1):
            bits, left, open_now = [1], size - 1, 1
            while left or open_now:
                if left and (open_now == 1 or rng.random() < steep):
                    bits.append(1)
                    left, open_now = left - 1, open_now + 1
                elif open_now > 1 or not left:
                    bits.append(0)
                    open_now -= 1
            stack, close = [], {}
            for place, bit in enumerate(bits):
                if bit:
                    stack.append(place)
                else:
                    close[stack.pop()] = place
            got = prefix_trie.find_close(np.array(bits, np.int8))
            assert got.tolist() == [close[p] for p in sorted(close)]


def plain_nodes(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    leaves, saved, children = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own_saved
            leaves[node[:d]] += not children[node]
    out = Counter()
    for node, convs in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out[min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], sha] += 1
    return out


def conversations(spark, rows):
    return spark.createDataFrame(
        [(t, c, "x", r, s, 1) for c, t, r, s in rows], "turn long, conv_id long, path string, role string, text string, depth int"
    )


def nodes(spark, rows):
    return Counter(tuple(r) for r in prefix_trie.trie_nodes(prefix_trie.rebuilt(conversations(spark, rows))).collect())


@pytest.mark.parametrize("kind", ["random", "copies", "chain", "alone"])
def test_trie_equals_a_plain_one(spark, kind):
    rng = random.Random(9)
    if kind == "random":
        rows = [(c, t, rng.choice("ua"), rng.choice(["", "é", "bcd"])) for c in range(400) for t in range(rng.randint(1, 12))]
    elif kind == "copies":  # one conversation that most ids share, over all shards, and some that go on behind it
        rows = [(c, t, "u", f"text {t}") for c in range(0, 3000) for t in range(3)]
        rows += [(c, t, "u", f"text {t}") for c in range(3000, 3040) for t in range(9 + c % 3)]
    elif kind == "chain":
        rows = [(c, t, "u", "same") for c in range(60) for t in range(1 + 7 * (c // 5))] + [(900, t, "u", "same") for t in range(150)]
    else:
        rows = [(4, 0, "u", "own")]  # the group's first conversation is not there
    assert nodes(spark, rows) == plain_nodes(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 1, "u", "gone"), (1, None, None, None), (1, 2, "u", "a"), (1, 2, "u", "a"), (1, 2, "b", "a"), (2, 1, "", "x"),
        (2, 1, "", "x"), (2, 0, "é", "ü"), (3, -1, "u", None), (0, 1, "u", "a"), (0, None, "u", "b"), (10**12, 5, "u", "a"),
    ]
    assert nodes(spark, rows) == plain_nodes(rows)
    assert not nodes(spark, []) and not nodes(spark, [(None, 1, "u", "x")])


def test_conversations_without_own_turns_left_are_members_of_the_root(spark):
    """h turns are taken from a conversation that is not there, and none of one's own are behind them."""
    ids = [c for c in range(1, 300) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:20]
    rows = [(c, 0, "u", "only") for c in ids]
    got = nodes(spark, rows)
    assert got == plain_nodes(rows) and len(got) == 1


def test_trie_of_the_smallest_table(spark):
    table = read(spark, "/root/testdata/sf0.001", "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert Counter(tuple(r) for r in QUERIES["op13_parenthesis_trie"](spark, "/root/testdata/sf0.001").collect()) == plain_nodes(rows)
