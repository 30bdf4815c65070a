"""The corpus pipeline against a plain composition of its stages' definitions."""

import re

from conftest import SMALL
from test_operators import brute_components, jump

import corpus_pipeline
from loomwright.llm import langid, mixing, sharding
from loomwright.llm.tables import table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline_by_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = langid.fit(docs.filter(~langid.held_out(docs["doc_id"])))
    left = [r for r in langid.identify(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_SCORE]
    label = brute_components({r["doc_id"]: r["text"] for r in left})
    left = [r for r in left if label[r["doc_id"]] == r["doc_id"]]
    windows = set()
    for r in table(spark, SMALL, "benchmark").collect():
        ws = words(r["text"])
        windows |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9)) if ws}
    sizes = {len(w) for w in windows}
    clean = lambda ws: not any(tuple(ws[i : i + n]) in windows for n in sizes for i in range(len(ws) - n + 1))
    left = [r for r in left if clean(words(r["text"]))]
    base = spark.createDataFrame([(r["doc_id"], r["source"]) for r in left], "doc_id long, source string")
    want = sorted(r["doc_id"] for r in mixing.mix_sources(base, mixing.WEIGHTS).collect())
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in found) == want and want
    hashed = {r["doc_id"]: int(r["h"]) for r in base.select("doc_id", sharding.key_hash(base["doc_id"]).alias("h")).collect()}
    assert all(r["shard"] == jump(hashed[r["doc_id"]], 24) for r in found)
    kept = {r["doc_id"]: r["text"] for r in left}
    assert all(r["text"] == kept[r["doc_id"]] for r in found)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_stage_rejects_noise_and_keeps_the_rest(spark):
    docs = table(spark, SMALL, "documents")
    planted = spark.createDataFrame([(-1, "zqx vkj wqz xjq " * 40, None, None, 0), (-2, "日本語の文章です。" * 40, None, None, 0), (-3, None, None, None, 0), (-4, "12 34", None, None, 0)], COLUMNS)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(planted), SMALL)
    assert kept.columns == docs.columns and kept.filter("doc_id < 0").isEmpty()
    assert kept.count() >= 0.98 * docs.filter("text RLIKE '[a-z]'").count()


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    import pyarrow.parquet as pq
    from test_against_sql import BENCHMARK, odd_texts, write

    for name, texts in (("none", []), ("odd", odd_texts()[0] * 2)):
        (tmp_path / name).mkdir()
        rows = [{"doc_id": None if n == 3 else n % 40, "text": t, "lang": [None, "en", "de"][n % 3], "source": [None, "src0", "src1"][n % 3], "n_chars": None} for n, t in enumerate(texts)]
        write(tmp_path / name, "documents", rows)
        pq.write_table(BENCHMARK.empty_table(), tmp_path / name / "benchmark.parquet")
        found = corpus_pipeline.run(spark, str(tmp_path / name))
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "grown_shard"]
        slots = sorted((r["shard"], r["slot"]) for r in found.collect())
        assert len(set(slots)) == len(slots) and bool(slots) == bool(texts)


def test_stages_keep_clashing_columns(spark):
    names = ["lang_pred", "score", "contamination", "key", "copy", "row_key", "once", "shard"]
    docs = spark.createDataFrame([(n, "the end of the story and of the day", "en", "src1", 1, *(f"{c} {n}" for c in names)) for n in range(9)], COLUMNS + "".join(f", {c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SMALL)
        assert found.columns == docs.columns, name
        assert all(r[c] == f"{c} {r['doc_id']}" for r in found.collect() for c in names), name


def test_copies_stand_apart(spark):
    docs = spark.createDataFrame([(n, f"text {n}", "src1") for n in range(1_000) for _ in range(6)] + [(None, "a", "src1"), (None, "b", None)], "doc_id long, text string, source string")
    found = corpus_pipeline.sharding(spark, docs, SMALL).collect()
    slots = {(r["shard"], r["slot"]): r["doc_id"] for r in found}
    assert len(slots) == len(found) == 6_002 and all(slot == 0 or (shard, slot - 1) in slots for shard, slot in slots)
    together = sum(key is not None and slots.get((shard, slot + 1)) == key for (shard, slot), key in slots.items())
    assert together < 300  # of 5,000 that could be; chance gives about 1 in 40 of the rows
