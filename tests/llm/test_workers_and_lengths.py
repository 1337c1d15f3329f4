"""Workers without the package, long texts in fits, and memory bounds of the token files."""

from __future__ import annotations

import json
import random
import subprocess
import sys
from collections import Counter

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stratawork.llm import decontaminate, language_id, minhash, mixing, prefix_trie, spelling, token_files, toxicity, topk
from stratawork.llm.queries import tokenizer_file
from stratawork.llm.text import pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_workers_need_no_package(tmp_path):
    """Functions of the operators are unpickled in a process that can't import the package."""
    given = [
        spelling._counter(6, 199), prefix_trie._shard, prefix_trie._digests, token_files._writer("file:///tmp", None, 1, "<u2", "whole"),
        token_files._reader("file:///tmp"), decontaminate._items(decontaminate.MASKS), decontaminate._candidates(decontaminate.MASKS, [3], None),
        minhash._signatures(5, 64, 4), minhash._sets(5), language_id._predictor(None), language_id._frequencies, toxicity._scorer(None),
        topk._tabled(None, 4), topk._searched(None, 4, 10),
    ]
    file = tmp_path / "functions"
    file.write_bytes(cloudpickle.dumps(given))
    code = f"import sys, pickle; sys.path = [p for p in sys.path if p not in ('', '/root/repo')]\nprint(len(pickle.load(open({str(file)!r}, 'rb'))), 'stratawork' in sys.modules)"
    done = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(given)), "False"], done.stderr[-800:]


def test_pieces_lie_all_over_a_text(spark):
    df = spark.createDataFrame([("a" * 50,), ("".join(chr(97 + k // 100) for k in range(1000)),), (None,), ("",)], "text string")
    short, long, none, empty = (r[0] for r in df.select(pieces("text", 100)).collect())
    assert short == "a" * 50 and none is None and empty == ""
    assert len(long) == 104 and [part[0] for part in long.split("\n")] == ["a", "c", "e", "h", "j"]


def labelled(spark, length):
    rng = random.Random(4)
    clean = "the garden was quiet and the children walked along river in light of morning".split()
    toxic = "vile scum trash hate you idiot filth".split()
    rows, labels = [], []
    for k in range(240):
        bad = k % 2
        words = rng.choices(clean, k=length // 6)
        if bad:
            for at in range(0, len(words), 7):
                words[at] = rng.choice(toxic)
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, bad))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_long_toxic_documents_are_learned_from(spark):
    docs, labels = labelled(spark, 12_000)
    assert docs.filter(F.length("text") < toxicity.MOST_CHARS).count() == 0
    kept = {r.doc_id for r in toxicity.clean_documents(docs, labels).collect()}
    assert kept == {k for k in range(240) if k % 2 == 0}


def test_a_language_of_long_documents_is_predicted(spark):
    rng = random.Random(5)
    words = {"en": "the of and house water people", "nl": "het van een huis water mensen"}
    rows = [
        (k, " ".join(rng.choices(words[lang].split(), k=3000 if lang == "nl" else 40)), lang, "s", 0)
        for k in range(160) for lang in [("en", "nl")[k % 2]]
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.lang_pred for r in language_id.languages(docs, language_id.train(docs)).collect()}
    assert all(got[k] == lang for k, _, lang, _, _ in rows)


TEXTS = [
    "Hello world", "  two  spaces\n\nlines\tand tabs ", "Été naïve größer's don't", "日本語 テキスト，中文。", "<s> </s> [UNK] <|endoftext|>", "", "a" * 3000,
    "words, and signs!! " * 50,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_gives_the_ids_of_whole_texts(spark, tmp_path, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    model = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    token_files.write_tokens(docs, f"file://{tmp_path}/files", path)
    got = {r.doc_id: (r.start, r.n_tokens) for r in token_files.read_tokens(spark, f"file://{tmp_path}/files").collect()}
    at = 0
    for k, text in enumerate(TEXTS):
        n = len(model.encode(text, add_special_tokens=False).ids) + 1
        assert got[k] == (at, n)
        at += n
    with open(path, encoding="utf-8") as file:
        assert token_files._fastest_way(file.read()) == ("cores" if name.startswith("word") else "whole")


def test_long_texts_are_cut_between_words_only(spark, tmp_path, monkeypatch):
    with open(tokenizer_file(), encoding="utf-8") as file:
        tokenizer = file.read()
    texts = [" ".join(TEXTS) * 30, "x" * 5000, "a\n" * 3000, "Größe, étés! " * 700, "", " " * 4000]
    wanted = token_files._encoder(tokenizer, 1, "<u2", "whole")(texts)
    monkeypatch.setattr(token_files, "PART_CHARS", 1000)
    assert token_files._encoder(tokenizer, 1, "<u2")(texts) == wanted
    monkeypatch.undo()
    docs = spark.range(1).select(F.lit(7).alias("doc_id"), F.repeat(F.lit("garden walls, "), 3_000_000).alias("text"))
    token_files.write_tokens(docs, f"file://{tmp_path}/long", tokenizer_file())
    one = len(token_files._encoder(tokenizer, 1, "<u2")(["garden walls, "])[0]) // 2 - 1
    assert token_files.read_tokens(spark, f"file://{tmp_path}/long").first().n_tokens == 3_000_000 * one + 1


def test_the_words_that_a_worker_keeps_are_bounded(monkeypatch):
    with open(tokenizer_file(), encoding="utf-8") as file:
        tokenizer = file.read()
    texts = [f"word{k} other{k % 7} again" for k in range(3000)]
    wanted = token_files._encoder(tokenizer, 1, "<u2", "whole")(texts)
    monkeypatch.setattr(token_files, "CACHED_BYTES", 20_000)
    encode = token_files._encoder(tokenizer, 1, "<u2")
    assert [x for a in range(0, 3000, 100) for x in encode(texts[a : a + 100])] == wanted
    inner = next(c.cell_contents for c in encode.__closure__ if getattr(c.cell_contents, "__name__", "") == "encoded")
    known = next(c.cell_contents for c in inner.__closure__ if isinstance(c.cell_contents, dict) and len(c.cell_contents) > 1)
    assert len(known) < 400


def test_a_mix_of_documents_with_clashing_names(spark):
    rows = [(k, f"word {k} " * (k % 5 + 1), ("a", "b", None)[k % 3]) for k in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ("mix_size", "mix_weight", "mix_key", "row", "mix_source", "key_range", "cut_key", "mix_copies", "target")
    clashing = plain.withColumns({name: F.lit(name) for name in names})
    counts = [Counter(r.doc_id for r in mixing.mixed(df).collect()) for df in (plain, clashing)]
    assert counts[0] == counts[1]
    assert mixing.mixed(clashing).columns == clashing.columns
    assert json.dumps(sorted(mixing.mixed_documents(clashing).columns)) == json.dumps(
        sorted({*clashing.columns, "size", "source_size", "target", "copies", "taken"})
    )


def test_small_sets_are_linked_without_a_shared_bucket(spark, monkeypatch):
    """Sets of 3 to 20 shingles at just 0.75 are linked even where signatures never meet."""
    whole = minhash._signatures

    def apart(*given):
        run = whole(*given)

        def each(batches):
            for batch in run(batches):
                ids = batch.column("doc_id").to_pylist()
                bands = [[1000 * k + i for i in range(32)] for k in ids]  # no two documents in one bucket
                columns = [batch.column(n) if n != "bands" else pa.array(bands) for n in batch.schema.names]
                yield type(batch).from_arrays(columns, batch.schema.names)

        return each

    monkeypatch.setattr(minhash, "_signatures", apart)
    rows = []
    for k, n in enumerate(range(3, 20)):
        words = [f"w{k}x{i}" for i in range(n + 4)]
        more = words + [f"m{k}x{i}" for i in range(n // 3)]  # n shingles of n + n // 3
        rows += [(10 * k, " ".join(words), None, None, 0), (10 * k + 1, " ".join(more), None, None, 0), (10 * k + 2, f"alone {k} " + "z " * k, None, None, 0)]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    for k, n in enumerate(range(3, 16)):
        assert got[10 * k + 1].component_id == 10 * k and not got[10 * k + 1].kept, n
