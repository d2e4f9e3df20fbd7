"""What runs hand on to each other: remembered lookups, styles as data, and reports of documents that arrive in parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bibliospark.operators import memo, render
from bibliospark.plans import corpus
from bibliospark.streaming import ingest

DAY = dt.datetime(2024, 1, 1)


def asked(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_only_new_or_old_keys_are_looked_up(spark, tmp_path):
    path, seen = f"{tmp_path}/memo", []

    def look_up(rows):
        seen.append(sorted(r.key for r in rows.collect()))
        return rows.where("key <> 'none'").select("key", F.upper("key").alias("name"), F.lit(len(seen)).alias("run"))

    run = lambda keys, day, age=None: {(r.key, r.name, r.run) for r in memo.remembered(asked(spark, *keys), path, look_up, age, DAY + dt.timedelta(days=day)).collect()}
    assert run(["a", "none", None], 0) == {("a", "A", 1)}
    assert run(["a", "none", "b"], 5) == {("a", "A", 1), ("b", "B", 2)}
    assert run(["a", "none", "b"], 6) == {("a", "A", 1), ("b", "B", 2)}
    assert seen == [["a", "none"], ["b"]]  # what was not found is remembered too; the third run asks nothing
    memo.compact(spark, path)
    assert len(memo._runs(path)) == 1 and run(["b"], 7) == {("b", "B", 2)}
    assert run(["a", "b"], 9, dt.timedelta(days=5)) == {("a", "A", 3), ("b", "B", 2)}  # a is nine days old, b four
    assert seen == [["a", "none"], ["b"], ["a"]]
    assert run(["a"], 10) == {("a", "A", 3)}


def test_memory_of_nothing(spark, tmp_path):
    empty = asked(spark).select("key")
    got = [memo.remembered(empty, f"{tmp_path}/memo", lambda rows: rows.withColumn("name", F.lit("x"))) for _ in range(2)]
    assert [df.columns for df in got] == [["key", "name"]] * 2 and got[1].count() == 0


def test_all_styles_in_one_plan(spark, sf_dir):
    refs = corpus.refs(spark, sf_dir).where("doc_id < 400")
    names = [s[0] for s in render.STYLES] + ["harvard"]
    patterns = render.styles(spark)
    for n, name in enumerate(names):
        chosen = refs.select("doc_id", F.lit(name).alias("style"))
        one = render.rendered(refs, render.style(name))
        assert one.exceptAll(render.rendered_each(refs, chosen, patterns)).count() == 0, name
    none = render.rendered_each(refs, chosen.limit(0), patterns)
    assert render.rendered(refs, render.style("apa")).exceptAll(none).count() == 0


def test_styles_learned_by_group(spark):
    rows = [("a", 1, "Smith J, Lee K. A title. Sleep 2006;29(1):85-93."), ("a", 2, "Stone B. More. Brain 2011;7(4):41-44."), ("b", 3, 'Smith, J., & Lee, K. (2006). "A title". Sleep, 29, 1-3.'), ("c", 4, "nothing"), (None, 5, "Smith, J. (2001). T.")]
    examples = spark.createDataFrame(rows, "style string, example_ord int, example string")
    got = {r.style: r.asDict() for r in render.learned_styles(examples).collect()}
    assert set(got) == {"a", "b"}  # c shows nothing, so it is apa
    for name in got:
        assert got[name] | {"style": "custom"} == render.learned_style(examples.where(F.col("style") == name))
    assert got["a"]["grouped"] and got["b"]["quotes"] and got["b"]["last_sep"] == ", & "


def test_late_entry_changes_the_report_once(spark, tmp_path):
    at = lambda name: f"{tmp_path}/{name}"

    def arrive(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(at(name))

    def run():
        query = ingest.checked(ingest.documents(spark, at("bodies")), ingest.entries(spark, at("entries")), at("out"), at("checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None

    body, entry = "doc_id long, body string", "doc_id long, ref_ord int, raw_text string"
    arrive("bodies", [(1, "Known (Smith, 2020) and (Jones, 2010)."), (2, "Known (Smith, 2020).")], body)
    arrive("entries", [(1, 1, "Smith, A. (2020). A study of sleep. Brain, 1(2), 3-4."), (2, 1, "Smith, A. (2020). A study of sleep. Brain, 1(2), 3-4.")], entry)
    run()
    first = {r.doc_id: (r.n_citations, r.n_references, r.n_matched) for r in ingest.current(spark, at("out")).collect()}
    assert first == {1: (2, 1, 1), 2: (1, 1, 1)}
    arrive("entries", [(1, 2, "Jones, B. (2010). On memory. Brain, 2(2), 5-6.")], entry)
    run()
    run()  # nothing new
    now = {r.doc_id: (r.n_citations, r.n_references, r.n_matched) for r in ingest.current(spark, at("out")).collect()}
    assert now == {1: (2, 2, 2), 2: (1, 1, 1)}
    rows = spark.read.parquet(at("out") + "/report")
    assert rows.where("doc_id = 1 and n_references = 2").count() == 1 and rows.where("doc_id = 2").select("batch").distinct().count() == 1
