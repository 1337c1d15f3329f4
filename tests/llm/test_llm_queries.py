"""The registered queries and the pipeline over the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest

import corpus_pipeline
from oracle import connect
from stratawork.llm import toxicity
from stratawork.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from stratawork.llm.text import read, stored
from test_text_operators import plain_components, plain_targets, shingles

SF_DIR = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_": ["doc_id", "held_out", "score", "predicted"],
    "op2_": ["page_id", "url", "text", "n_chars"],
    "op3_": ["page_id", "host", "path", "rule", "verdict"],
    "op4_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_": ["doc_id", "size", "source_size", "target"],
    "op9_": ["query_id", "rank", "vec_id", "score"],
    "op10_": ["doc_id", "item_id"],
    "op11_": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12_": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op13_": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


def test_one_query_for_each_operator():
    assert len(QUERIES) == len(COLUMNS)
    assert all(sum(name.startswith(prefix) for name in QUERIES) == 1 for prefix in COLUMNS)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_returns_its_whole_table(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    wanted = next(c for prefix, c in COLUMNS.items() if name.startswith(prefix))
    assert df.columns[: len(wanted)] == wanted
    table = "pages" if name.startswith(("op2_", "op3_")) else "documents"
    rows = df.count()
    assert 0 < rows if name.startswith("op10_") else rows == read(spark, SF_DIR, table).count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import oracle

    assert oracle.compare(spark, connect(SF_DIR), name, SF_DIR) == ""


def plain_toxicity(spark, rows, docs):
    """Not a second field: the documents that the operator's own scores let pass."""
    field = toxicity.train(docs, read(spark, SF_DIR, "labels"))
    return sorted(r.doc_id for r in toxicity.scores(docs, field).collect() if r.score < 0.3)


def plain_near_duplicates(spark, rows, docs):
    component = plain_components({r.doc_id: shingles(r.text) for r in rows})
    return sorted(i for i, c in component.items() if i == c)


def plain_decontamination(spark, rows, docs):
    """Every alignment of every document with every item, word by word: ten points, or 80 % of 13 words or of a shorter item."""
    words_of = lambda text: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())
    items = {r.item_id: words_of(r.text) for r in read(spark, SF_DIR, "benchmark").collect()}
    where = {}
    for item, words in items.items():
        for k, word in enumerate(words):
            where.setdefault(word, []).append((item, k))
    clean = []
    for r in rows:
        own = words_of(r.text)
        equal = Counter((item, at - k) for at, word in enumerate(own) for item, k in where.get(word, ()))
        best = False
        for (item, shift), n in equal.items():
            wanted, size = items[item], len(items[item])
            if n < min(10, size) and 100 * n < 80 * min(size, 13):
                continue
            same = [own[k + shift] == word for k, word in enumerate(wanted) if 0 <= k + shift < len(own)]
            now = 0
            for equal_word in same:  # ten points, or every word of a shorter item
                now = max(0, now + (1 if equal_word else -2))
                best = best or now >= min(10, size)
            windows = range(max(len(same) - 12, 1)) if size >= 8 else ()
            best = best or any(100 * sum(same[i : i + 13]) >= 80 * min(size, 13) for i in windows)
        if not best:
            clean.append(r.doc_id)
    return sorted(clean)


def plain_mix(spark, rows, docs):
    sizes, keyed = {}, []
    for r in rows:
        text = r.text or ""
        letters = len(re.sub(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "", text))
        weight = 0.5 + 0.5 * letters / max(1, len(text)) if r.text is not None else 0.5
        u = (int(hashlib.md5(f"{r.doc_id}:mix".encode()).hexdigest()[:13], 16) + 1) / 2**52
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        sizes[r.source] = sizes.get(r.source, 0) + n
        keyed.append((-math.log(u) / weight, r.doc_id, r.source, n))
    target, started, taken = plain_targets(sizes), dict.fromkeys(sizes, 0), []
    for _, doc_id, source, n in sorted(keyed):
        epochs = int(target[source] / sizes[source]) if sizes[source] else 0
        rest = target[source] - epochs * sizes[source]
        taken += [doc_id] * (epochs + (rest > 1e-9 and started[source] + n / 2 <= rest))
        started[source] += n
    return sorted(taken)


def plain_tokens(spark, rows, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file())
    return sorted((r.doc_id, len(model.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in rows)


PLAIN = [plain_toxicity, plain_near_duplicates, plain_decontamination, plain_mix, plain_tokens]


def test_pipeline(spark):
    """Each stage against a plain version over its own input; all but the last return the documents' columns."""
    docs = read(spark, SF_DIR, "documents")
    columns, given = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    counts = [len(given)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN, strict=True):
        expected = plain(spark, docs.collect(), docs)
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        rows = docs.collect()
        counts.append(len(rows))
        if name == "token_files":
            assert sorted((r.doc_id, r.n_tokens) for r in rows) == expected
        else:
            assert sorted(r.doc_id for r in rows) == expected, name
            assert docs.columns == columns and all(given[r.doc_id] == r.text for r in rows)
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    again = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r[:4] for r in again) == sorted(r[:4] for r in rows)
