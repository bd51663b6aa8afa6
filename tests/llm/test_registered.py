import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from proofloom.llm import line_crf, mixing, queries, sharding, spaced_seeds
from proofloom.session import TABLES

from . import helpers

ROOT = Path(entry.__file__).parent
SF = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert set(names) == set(df.columns)
    show = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert show(df.select(*names).collect()) == show(cur.fetchall())


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "shards"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in line_crf.classify(docs, labels).filter("predicted = 1").collect()}
    groups = helpers.near_duplicates([(i, rows[i]["text"]) for i in good])
    single = {i for i in good if groups[i][1] == i}
    items = [" ".join(helpers.words(r["text"])) for r in bench.collect()]
    clean = {i for i in single if not any(f" {t} " in f" {' '.join(helpers.words(rows[i]['text']))} " for t in items)}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "slot", "shard"]
    got = {}
    for r in out.collect():
        assert tuple(r)[:5] == tuple(rows[r["doc_id"]])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert set(got) <= clean and max(got.values()) <= mixing.MAX_COPIES
    mixed = mixing.mix(docs.filter(docs["doc_id"].isin(clean)), merit=mixing.length_merit(docs["text"])).collect()
    assert got == {r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["taken"]}
    owner, names = sharding.lookup_table(sharding.shard_names()), sharding.shard_names()
    assert all(r["shard"] == names[owner[r["slot"]]] for r in out.select("slot", "shard").distinct().collect())


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "a", 1.5) for r in helpers.odd_documents()], helpers.DOCS + ", kept string, score double")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, helpers.prose(30, 500))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns[:7] == docs.columns and (len(rows.columns) == 7 or i == 4)
        rows.collect()


def test_the_rest_imports_without_these_folders():
    code = ("import sys; sys.modules['proofloom.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "proofloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "proofloom").parts:
            assert "llm" not in path.read_text()
