import corpus_pipeline
from lumenframe.llm.exact_dedup import exact_dedup
from lumenframe.llm.minhash import near_duplicates


def test_pipeline_on_a_small_table(spark, tmp_path):
    en, fr = "the house of the small river and this other thing again", "la maison de la petite rivière et cette autre chose encore"
    rows = [(i, f"{(en if i % 2 else fr)} number{i} w{i * 3} x{i * 5} y{i * 7}", "en" if i % 2 else "fr", f"src{i % 4}", 10) for i in range(80)]
    rows += [(100, rows[5][1], "en", "src0", 10), (101, None, None, "src1", 0), (102, "123 456", None, None, 7), (103, rows[7][1].replace("  ", " ") + " ", "en", "src2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.language(spark, docs, str(tmp_path)).cache()
    assert first.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {101, 102}
    second = corpus_pipeline.exact(spark, first, str(tmp_path)).cache()
    assert second.columns == docs.columns
    assert sorted(r.doc_id for r in second.collect()) == sorted(r.doc_id for r in exact_dedup(first).where("kept").collect())
    third = corpus_pipeline.near(spark, second, str(tmp_path)).cache()
    assert sorted(r.doc_id for r in third.collect()) == sorted(r.doc_id for r in near_duplicates(second).where("kept").collect())
    fourth = corpus_pipeline.mixture(spark, third, str(tmp_path))
    assert fourth.columns == docs.columns
    assert {r.doc_id for r in fourth.collect()} <= {r.doc_id for r in third.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in fourth.collect()}


def test_stages_on_odd_tables(spark, tmp_path):
    """Repeated and null keys, null texts, clashing names and an empty table at every stage."""
    text = "the small house by the river and the old bridge number"
    rows = [(i, f"{text} {i} w{i * 3} x{i * 5} y{i * 7} z{i * 11}", "en", f"src{i % 3}" if i % 5 else None, 10) for i in range(40)]
    rows += [(3, f"{text} of another kind with that key", "en", "src1", 10), (4, rows[4][1], "en", "src1", 10), (None, f"{text} of nobody", None, None, 1), (None, f"{text} of nobody", None, None, 1), (None, None, None, None, 0), (60, "", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS gone_key", "2 AS text_sha256", "3 AS kept", "4 AS times_taken", "5 AS row_digest", "6 AS score", "7 AS size", "8 AS start")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path)).cache()
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            assert {t for r in docs.collect() for t in [r.text] if t} >= {r.text for r in out.collect() if r.text}
        if name in ("language_id", "exact_dedup", "near_dedup"):
            got = [r.text for r in out.collect()]
            assert {t for _, t, *_ in rows if t} == {t for t in got if t}
        docs = out
    assert docs.count() > 0


def test_a_task_gives_its_memory_back():
    import os
    from pathlib import Path

    import numpy as np

    from lumenframe.llm.session import frugal

    held = []

    def mb() -> float:
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20

    def run(batches):
        for b in batches:
            large = [np.ones(8000) for _ in range(4000)]  # 244 MB in pieces that malloc keeps
            held.append(large[-1])  # at the end of them, so that the heap can't shrink by itself
            del large
            held.append(mb())
            yield b

    assert list(frugal(run)(iter([1, 2]))) == [1, 2]
    assert mb() < max(x for x in held if isinstance(x, float)) - 150
