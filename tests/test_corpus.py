"""Chunking against plain loops, and the store sinks."""

import pytest
from pyspark.sql import functions as F

from tallyglass.functions import text as X
from tallyglass.operators import chunking as C
from tallyglass.plans.corpus import document_corpus
from tallyglass.sources import readers, writers


def doc(spark, content, title="T"):
    return spark.createDataFrame([("d", title, "/u", content)], "doc_id string, title string, url string, content string")


def packed(paragraphs, size=220, overlap=40):
    """Brute force: pack paragraphs, carry a tail of whole ones, cut oversized ones."""
    chunks, held = [], []
    total = lambda ps: sum(len(p.split()) for p in ps)

    def close():
        nonlocal held
        if held:
            chunks.append("\n".join(held))
            keep = []
            while len(keep) < len(held) and total(held[len(held) - len(keep) - 1:]) <= overlap:
                keep = held[len(held) - len(keep) - 1:]
            held = keep

    for p in paragraphs:
        words = p.split()
        if len(words) > size:
            close()
            chunks += [" ".join(words[i:i + size]) for i in range(0, len(words), size)]
        else:
            if total(held) + len(words) > size:
                close()
            held = held + [p]
    close()
    return chunks


def test_recursive_equals_a_plain_loop(spark, sf_dir):
    docs = document_corpus(spark, sf_dir)
    made = C.recursive_chunks(docs, size=60, overlap=15, separator="\n").orderBy("doc_id", "ordinal").collect()
    by_doc = {}
    for row in made:
        by_doc.setdefault(row.doc_id, []).append(row.content)
    for row in docs.collect():
        paragraphs = [p.strip() for p in row.content.split("\n") if p.strip()]
        assert by_doc.get(row.doc_id, []) == [c.strip() for c in packed(paragraphs, 60, 15)], row.doc_id


def test_headings_inside_fences_are_text(spark):
    text = "intro\n## One {#one}\n```\n# not a heading\n```\nbody\n### Two\nmore\n##### five is text"
    rows = doc(spark, text).select(F.inline(C.sections("content"))).collect()
    assert [(r.heading, r.body) for r in rows] == [
        (None, "intro"), ("One", "```\n# not a heading\n```\nbody"), ("Two", "more\n##### five is text")]


def test_short_sections_survive_only_at_the_start(spark):
    short, long = "a few words", " ".join(f"w{i}" for i in range(250))
    rows = C.header_chunks(doc(spark, f"{short}\n# Tiny\n{short}\n# Big\n{long}")).orderBy("ordinal").collect()
    assert [r.section for r in rows] == [None, "Big", "Big"]
    assert [r.ordinal for r in rows] == [0, 1, 2]
    assert rows[1].content.startswith("T — Big\n\nw0 ") and rows[0].chunk_id == "d:header:0000"


def test_fixed_windows_cover_every_word(spark, sf_dir):
    docs = document_corpus(spark, sf_dir)
    rows = C.fixed_chunks(docs).groupBy("doc_id").agg(F.max(F.col("ordinal") * 180 + F.col("token_count")).alias("n"))
    short = docs.select("doc_id", X.word_count("content").alias("all")).join(rows, "doc_id").filter("all - n >= 20 OR n > all")
    assert short.count() == 0
    assert C.fixed_chunks(doc(spark, "")).count() == 0


def test_unknown_strategy_is_an_error(spark):
    with pytest.raises(KeyError):
        C.chunk_documents(doc(spark, "x"), "semantic")


def test_store_reload_keeps_other_strategies(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = doc(spark, "# A\n" + " ".join(["word"] * 300))
    writers.build_index(docs, path, ("fixed", "header"))
    rows = writers.read_store(spark, path)
    before = {r.strategy: r.chunks for r in writers.store_statistics(rows, ["strategy"]).collect()}
    half = C.fixed_chunks(docs, size=110).withColumn("embedding", F.array_repeat(F.lit(0.5).cast("float"), 256))
    assert writers.load_chunks(half, path) == 256
    after = {r.strategy: r.chunks for r in writers.store_statistics(writers.read_store(spark, path), ["strategy"]).collect()}
    assert after["header"] == before["header"] and after["fixed"] > before["fixed"]
    with pytest.raises(ValueError):
        writers.load_chunks(half.withColumn("embedding", F.when(F.col("ordinal") > 0, F.col("embedding"))), path)
    smaller = half.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert writers.load_chunks(smaller, path) == 1
    assert [r.strategy for r in writers.read_store(spark, path).select("strategy").distinct().collect()] == ["fixed"]


def test_markdown_scan(spark, tmp_path):
    body = "text " * 100
    (tmp_path / "docs" / "a").mkdir(parents=True)
    (tmp_path / "docs" / "a" / "page.md").write_text(f"---\ntitle: 'A page'\n---\n<!-- x -->{body}")
    (tmp_path / "docs" / "b.md").write_text(f"---\nweight: 1\n---\n{body}")
    (tmp_path / "docs" / "c.md").write_text("---\ntitle: Short\n---\nshort")
    rows = readers.markdown_corpus(spark, str(tmp_path / "docs"), "https://x.org").collect()
    assert [(r.title, r.path, r.url) for r in rows] == [("A page", "a/page.md", "https://x.org/a/page/")]
    with pytest.raises(FileNotFoundError):
        readers.saved_documents(spark, str(tmp_path / "nothing"))


def test_section_index_pages_are_read(spark, tmp_path):
    body = "text " * 100
    (tmp_path / "docs" / "a").mkdir(parents=True)
    for name in ("_index.md", "page.md"):
        (tmp_path / "docs" / "a" / name).write_text(f"---\ntitle: {name}\n---\n{body}é")
    rows = readers.markdown_corpus(spark, str(tmp_path / "docs"), "https://x.org").collect()
    assert {(r.title, r.path, r.url) for r in rows} == {("_index.md", "a/_index.md", "https://x.org/a/"), ("page.md", "a/page.md", "https://x.org/a/page/")}
    assert {r.content[-1] for r in rows} == {"é"}


def test_store_is_swapped_by_its_pointer(spark, tmp_path):
    """A reader sees the old store or the new one; a failed load changes nothing; an upsert touches text and vector only."""
    path = f"{tmp_path}/store"
    columns = "chunk_id string, doc_id string, doc_title string, ordinal int, content string, embedding array<float>, strategy string"
    row = lambda s, i, title, text, v: (f"{s}{i}", f"d{i}", title, i, text, [v, v], s)
    writers.load_chunks(spark.createDataFrame([row(s, i, "old", "text", 1.0) for s in ("fixed", "header") for i in range(4)], columns), path)
    before = writers.read_store(spark, path)
    writers.upsert_store(spark.createDataFrame([row("header", 3, "new", "changed", 2.0), row("header", 9, "new", "added", 2.0)], columns), path)
    assert before.filter("content = 'text'").count() == 8 == before.count()
    after = {r["chunk_id"]: r for r in writers.read_store(spark, path).collect()}
    assert len(after) == 9 and after["header3"]["doc_title"] == "old" and after["header3"]["content"] == "changed"
    assert list(after["header3"]["embedding"]) == [2.0, 2.0] and after["header9"]["doc_title"] == "new" and after["fixed3"]["content"] == "text"
    parts = writers.store_parts(spark, path)
    with pytest.raises(ValueError):
        writers.load_chunks(spark.createDataFrame([row("fixed", 0, "x", "x", 1.0), ("fixed1", "d", "t", 1, "c", None, "fixed")], columns), path)
    assert writers.store_parts(spark, path) == parts and len(set(parts.values())) == 2
    assert {r["strategy"] for r in writers.read_store(spark, path, ["fixed"]).select("strategy").distinct().collect()} == {"fixed"}
    with pytest.raises(FileNotFoundError):
        writers.read_store(spark, path, ["recursive"])
    writers.upsert_store(spark.createDataFrame([row("recursive", 0, "t", "c", 1.0)], columns), path)
    assert writers.read_store(spark, path).count() == 10
