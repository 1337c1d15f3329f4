"""Near-duplicates, decontamination, mixing, shards and token files against plain versions, and their odd inputs."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from stratawork.llm import decontaminate, minhash, mixing, sharding, token_files
from stratawork.llm.queries import tokenizer_file
from stratawork.session import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use themselves.
CLASHING = ["size", "target", "rep", "component_id", "kept", "part", "score", "weight", "row", "doc_key", "text_hash", "bucket", "copies"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_text(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(n))


def edited(draw, text, n):
    parts = text.split()
    for _ in range(n):
        parts[draw.randrange(len(parts))] = some_text(draw, 1)
    return " ".join(parts)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies in a chain, short, empty and null texts, a hot source, one long text."""
    draw = random.Random(4)
    texts = [some_text(draw, draw.randint(20, 120)) for _ in range(60)]
    texts += [texts[0]] * 25 + [edited(draw, texts[1], n % 6) for n in range(40)] + [edited(draw, texts[2], n % 3).upper() for n in range(10)]
    chain = some_text(draw, 200)
    for _ in range(6):
        texts.append(chain)
        chain = edited(draw, chain, 3)
    texts += ["", None, "   \n\t", "one two", "ONE  two", "one", "a b c d e", "x\x00y äÖ 　", some_text(draw, 20_000)]
    sources = ["hot"] * (len(texts) // 2) + [draw.choice(["a", "b", None]) for _ in range(len(texts) - len(texts) // 2)]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i, t, "en", s, len(t or "")) for i, t, s in zip(order, texts, sources)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, repeated ids, and columns with names the operators use."""
    rows = [(None, "a b c d e f g", "en", "s", 7), (1, "a b c d e f g", None, None, None), (1, "a b c d e f g", None, None, None),
            (1, "other words for the same id are here now", "en", "s", 3), (2, None, "en", "s", 0), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        frame = frame.selectExpr("*", f"'{name}' AS {name}")
    return frame


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width=5):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)}


def plain_components(sets, threshold=75):
    of = {i: i for i in sets}
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        common = len(x & y)
        if common and 100 * common >= threshold * len(x | y) and of[a] != of[b]:
            low, high = sorted((of[a], of[b]))
            of = {i: low if c == high else c for i, c in of.items()}
    return of


def test_near_duplicates_equal_all_pairs(docs, corpus):
    sets = {i: shingles(t) for i, t, *_ in corpus}
    truth = plain_components(sets)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in found.items()} == truth
    assert all(found[i].n_shingles == len(s) and found[i].kept == (truth[i] == i) for i, s in sets.items())
    assert len(set(truth.values())) < len(truth) - 60
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(truth.values())


def test_unconnected_members_of_a_bucket_are_compared(spark):
    """Many copies that differ too much from each other, and some pairs among them that are linked."""
    draw = random.Random(8)
    base = some_text(draw, 120)
    texts = [edited(draw, base, draw.randint(0, 9)) for _ in range(120)]
    texts += [edited(draw, texts[k], 1) for k in range(0, 120, 3)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()}
    assert found == plain_components(sets)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = sorted(minhash.near_duplicates(odd).collect(), key=str)
    assert len(rows) == 6
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert all(r.component_id == 1 and r.kept for r in rows if r.doc_id == 1)
    assert minhash.deduplicated(odd).columns == odd.columns and minhash.deduplicated(odd).count() == 6
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicated(none).count() == 0


def test_a_repeated_id_stands_for_each_of_its_texts(spark):
    """A class takes only the like one of two texts with one id; of like texts with one id one is kept."""
    draw = random.Random(23)
    x, z = some_text(draw, 80), some_text(draw, 80)
    like_x, like_z = edited(draw, x, 1), edited(draw, z, 1)
    rows = [(1, x), (5, like_x), (5, z), (7, like_z), (3, some_text(draw, 40)), (3, z + " more"), (8, x), (8, like_x)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows[:3]], SCHEMA)
    assert {(r.doc_id, r.text) for r in minhash.deduplicated(frame).collect()} == {(1, x), (5, z)}
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()) == [
        (1, 1, True), (5, 1, False), (5, 5, True)
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert {(r.doc_id, r.text) for r in minhash.deduplicated(frame).collect()} == {(1, x), rows[4], rows[5]}
    alike = spark.createDataFrame([(1, t, "en", "s", 0) for t in (x, x, like_x)], SCHEMA)
    kept = [r.text for r in minhash.deduplicated(alike).collect()]
    assert kept in ([x, x], [like_x])


def test_overlaps_find_whole_partial_and_edited_passages(spark):
    draw = random.Random(2)
    items = [(k, some_text(draw, 30)) for k in range(8)] + [(8, "too short"), (9, None), (10, "")]
    clean = [some_text(draw, 300) for _ in range(40)]
    planted = {}
    for k in range(24):
        passage = items[k % 8][1]
        if k >= 16:
            parts = passage.split()
            passage = " ".join(parts[:18])
        elif k >= 8:
            parts = passage.split()
            for at in (5, 14, 24):
                parts[at] = "zzz"
            passage = " ".join(parts)
        planted[100 + k] = (some_text(draw, 50) + "\n" + passage.upper() + "!! " + some_text(draw, 50), k % 8)
    rows = list(enumerate(clean)) + [(i, t) for i, (t, _) in planted.items()] + [(200, None), (201, ""), (None, planted[100][0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, k) for i, (_, k) in planted.items()} | {(None, 0)}
    exact = next(r for r in found if r.doc_id == 100)
    assert (exact.score, exact.matched, exact.item_words, exact.word_at) == (30, 30, 30, 50)
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(40)) | {200, 201}


def test_overlaps_allow_replaced_words_in_items_of_any_length(spark):
    """One or two replaced words of an item, at every place that the share allows; short items word for word."""
    draw = random.Random(21)
    bench, docs, truth = [], [], set()
    for n in (1, 2, 5, 7, 8, 9, 10, 11, 12, 13, 15, 30):
        item = [f"w{n}x{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        most = min(n, 13)
        spare = most - -(-4 * most // 5) if n >= 8 else 0
        for gone in itertools.chain([()], *(itertools.combinations(range(n), k) for k in range(1, min(spare, 2) + 2))):
            part = ["zzz" if k in gone else w for k, w in enumerate(item)]
            equal = [w != "zzz" for w in part]
            if n >= 13 and len(gone) == 3:
                continue
            docs.append((len(docs), f"{some_text(draw, 12)} {' '.join(part)}, {some_text(draw, 12)}"))
            if any(sum(equal[k : k + most]) >= most - spare for k in range(n - most + 1)):
                truth.add((docs[-1][0], n))
    docs.append((len(docs), "begins later: " + " ".join(f"w12x{k}" for k in range(2, 12))))
    truth.add((docs[-1][0], 12))
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.overlaps(frame, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == truth
    assert decontaminate.decontaminated(frame, bench).count() == len(docs) - len(truth)


def test_overlaps_without_spaces_between_words(spark):
    draw = random.Random(22)
    han = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    one, two = han(14), han(30)
    items = [(1, one), (2, two[:15] + "\u3002" + two[15:]), (3, "\u00abuno dos tres\u00bb\u2014\u201ccuatro cinco seis siete ocho\u201d")]
    docs = [
        (1, han(40) + one + han(40)), (2, han(9) + two[:5] + "\u4e00" + two[6:] + "\uff01" + han(9)), (3, han(200)),
        (4, "x\u2026uno dos tres\u00a0cuatro cinco seis siete\u2019ocho\u3001y"), (5, one[:7]), (6, "\U00020000\U0001f600\u00e9"),
    ]
    frame = spark.createDataFrame([(i, t, "zh", "s", 0) for i, t in docs], SCHEMA)
    found = decontaminate.overlaps(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in found} == {(1, 1, 14), (2, 2, 29), (4, 3, 8)}


def test_overlaps_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l")], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(odd, bench).count() == 0
    assert decontaminate.decontaminated(odd, empty).count() == 6 and decontaminate.decontaminated(odd, bench).columns == odd.columns
    assert decontaminate.overlaps(none, bench).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_names = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_names:
        total = sum(weight[s] for s in open_names)
        full = {s for s in open_names if target[s] + left * weight[s] / total >= most * sizes[s]}
        if not full:
            for s in open_names:
                target[s] += left * weight[s] / total
            break
        left -= sum(most * sizes[s] - target[s] for s in full)
        for s in full:
            target[s] = most * sizes[s]
        open_names -= full
    return target


def test_mix_meets_its_targets(docs, corpus):
    rows = mixing.mixed_documents(docs).collect()
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        assert r.size == len(words(r.text)) and r.taken == r.copies * r.size <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    target = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mixed_documents(docs.repartition(5)).select("doc_id", "copies").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.copies) for r in rows)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in rows)


def test_mix_takes_complete_epochs_before_a_part(spark):
    rows = [(i, "w " * 10, "en", "a", 0) for i in range(10)] + [(100 + i, "w " * 10, "en", "b", 0) for i in range(200)]
    found = mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.copies for r in found if r.source == "a"} == {3}
    assert {r.copies for r in found if r.source == "b"} == {0, 1}


def test_mix_of_odd_rows(odd, none):
    found = mixing.mixed_documents(odd)
    assert found.count() == 6 and {r.row for r in found.collect()} == {"row"}
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed_documents(none).count() == 0 and mixing.mixed(none).count() == 0


def shard_facts(rows, n):
    total = sum(r.size for r in rows)
    loads = [sum(r.size for r in rows if r.shard == k) for k in range(n)]
    for k in range(n):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    return total, loads


def test_shards_are_balanced_and_keep_copies_together(spark):
    draw = random.Random(6)
    texts = [some_text(draw, draw.randint(5, 60)) for _ in range(1500)]
    texts += [texts[0]] * 60 + [None, ""]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = sharding.kd_shards(frame, 8).collect()
    assert len(rows) == len(texts) and all(r.size == len((texts[r.doc_id] or "").encode()) + 1 for r in rows)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    total, loads = shard_facts(rows, 8)
    assert max(loads) - min(loads) < 0.05 * total / 8
    assert len({r.shard for r in rows if texts[r.doc_id] == texts[0]}) == 1
    odd_number = sharding.kd_shards(frame, 5).collect()
    total, loads = shard_facts(odd_number, 5)
    assert max(loads) - min(loads) < 0.06 * total / 5
    assert len({r.shard for r in sharding.kd_shards(frame, None, total // 3 + 1).collect()}) == 3


def test_a_group_of_copies_larger_than_a_shard_is_split(spark):
    draw = random.Random(7)
    texts = ["the same words again and again"] * 700 + [some_text(draw, 6) for _ in range(700)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    total, loads = shard_facts(sharding.kd_shards(frame, 8).collect(), 8)
    assert max(loads) - min(loads) < 0.08 * total / 8


def test_shards_of_odd_rows(odd, none):
    assert sharding.kd_shards(odd, 8).count() == 6
    assert sharding.kd_shards(none, 8).count() == 0


def test_token_files_equal_the_tokenizer(spark, docs, corpus):
    from tokenizers import Tokenizer

    folder = new_folder(spark, "test-tokens")
    manifest = token_files.write_tokens(docs, folder, tokenizer_file())
    assert manifest.agg({"docs": "sum"}).first()[0] == len(corpus)
    found = {r.doc_id: r for r in token_files.read_tokens(spark, folder).collect()}
    model, at = Tokenizer.from_file(tokenizer_file()), 0
    for i, text, *_ in sorted(corpus):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_words_are_encoded_like_whole_texts():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file())
    encode = token_files._encoder(open(tokenizer_file(), encoding="utf-8").read(), 1, "<u2")
    texts = ["", " ", "\n\n a\tb c  d", "It's WE'LL o'clock '", "é ́x ΣΣ İ", "<|endoftext|> a<|startoftext|>b", "x\x1cy\x85z 12 3.4 !?€\U0001f600"]
    for text, coded in zip(texts, encode(texts)):
        assert np.frombuffer(coded, "<u2").tolist() == [*model.encode(text, add_special_tokens=False).ids, 1]


def test_token_files_of_odd_rows(spark, odd, none):
    folder = new_folder(spark, "test-tokens")
    token_files.write_tokens(odd, folder, tokenizer_file())
    rows = token_files.read_tokens(spark, folder).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(False, 0)] * 2 + [(True, 1)] * 3 + [(True, 2)]
    assert sorted(r.start for r in rows)[0] == 0
    folder = new_folder(spark, "test-tokens")
    token_files.write_tokens(none, folder, tokenizer_file())
    assert token_files.read_tokens(spark, folder).count() == 0
