from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.functions import keys, text
from rillmark.operators import access, analytics, evaluation, graph, lexical, maintenance, ranking
from rillmark.streaming import changes


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, text.tokens, "Ção_x 12-É") == ["cao", "x", "12", "e"]
    assert one(spark, text.html_text, "<head><title>t</title></head><p>a &amp; b</p><script>x</script><div>c</div>") == "a & b\nc"
    assert one(spark, text.document_name, "a/b/My_File  v2.tar.gz") == "My File v2.tar"
    assert one(spark, text.file_name, "a:b?") == "a_b_" and one(spark, text.file_name, "con") == "_con"
    assert one(spark, text.language, "the cat and the dog of a house") == "en" and one(spark, text.language, "x") == "indefinido"


def test_keys(spark):
    assert one(spark, keys.clean_path, "a\\b//./c") == "a/b/./c"
    with pytest.raises(Exception, match="not a relative path"):
        one(spark, keys.clean_path, "../x")
    assert one(spark, keys.source_group, "meetings/a.eml") == "email" and one(spark, keys.source_group, "Meetings/a.pdf") == "reuniao"
    assert one(spark, keys.is_dump, "a/db-dump_2.sql") is True and one(spark, keys.is_dump, "a/dumpling") is False
    got = {v: one(spark, lambda c: F.element_at(F.array(keys.column_letters(c.cast("int"))), 1), str(v)) for v in (1, 26, 27, 702, 703)}
    assert got == {1: "A", 26: "Z", 27: "AA", 702: "ZZ", 703: "AAA"}


def test_bm25_prunes_common_terms_and_breaks_ties(spark):
    chunks = spark.createDataFrame([("b", "x rare"), ("a", "x rare"), ("c", "x y"), ("d", "x")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "x rare"), (2, "x"), (3, "")], "query_id int, text string")
    got = [(r.query_id, r.item, r["rank"]) for r in lexical.bm25(queries, chunks, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)]


def test_phrases(spark):
    chunks = spark.createDataFrame([(1, "a b a b"), (2, "b a"), (3, None)], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "CT-20")], "query_id int, text string")
    assert [(r.query_id, r.item, r.hits) for r in lexical.phrase_hits(queries, chunks).collect()] == [(1, 1, 2)]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, item string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, item string, rank int")
    got = ranking.fuse([a, b, a], [1.0, 0.5, 0.0]).orderBy("rank").collect()
    assert [(r.item, r.score) for r in got] == [("y", pytest.approx(1 / 62 + 0.5 / 61, abs=1e-9)), ("x", pytest.approx(1 / 61, abs=1e-9))]
    with pytest.raises(ValueError):
        ranking.fuse([a], [1.0, 2.0])


def test_families(spark):
    names = ["d/Plan_v6_Comentado.docx", "d/Plan v2.docx", "d/plan (1).docx", "d/Plan_GC.pdf", "e/plan.docx"]
    stems = [r.s for r in spark.createDataFrame([(n,) for n in names], "path string").select(ranking.stem(F.col("path")).alias("s")).collect()]
    assert stems == ["plan"] * 5
    rows = [(1, p, i + 1, 100 - i) for i, p in enumerate(names)]
    got = ranking.collapse_families(spark.createDataFrame(rows, "query_id int, path string, rank int, mtime long")).orderBy("position").collect()
    assert [(r.path, r.formats, r.older) for r in got] == [(names[0], ["docx", "pdf"], [names[1], names[2]]), (names[4], ["docx"], [])]


def test_exact_neighbours_in_blocks(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [math.cos(1), math.sin(1)])]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    got = ranking.exact_neighbours(df.filter("id < 5"), df, k=3, block=2).collect()
    assert len(got) == 15 and [(r.item, r.score) for r in got if r.query_id == 1 and r["rank"] == 1] == [(102, 1.0)]


def test_identifiers(spark):
    found = one(spark, graph.identifiers, "ISO 42001:2023, iso/iec 27.001 e CT-2024-0142; 12.345.678/0001-90; Lei nº 8.666/93 ISO 42001")
    assert [tuple(x) for x in found] == [("norma", "ISO 42001"), ("norma", "ISO 27001"), ("lei", "LEI 8.666"), ("codigo", "CT-2024-0142"), ("cnpj", "12.345.678/0001-90")]
    found = one(spark, graph.identifiers, "PO-VCE-007 NR 12 PL 2338/2023 ISO-420012023 ISO 42001:2023 VCE-007 covid-19 Decreto 11.129/2022 0000123-45.2023.8.26.0100")
    assert [tuple(x) for x in found] == [
        ("norma", "NR 12"), ("norma", "ISO 42001"), ("lei", "PL 2338/2023"), ("lei", "DECRETO 11.129"), ("codigo", "PO-VCE-007"), ("processo", "0000123-45.2023.8.26.0100"),
    ]


def test_stems_and_versions(spark):
    stems = {p: one(spark, ranking.stem, p) for p in ("a/Cópia de plano.docx", "plano_v6_Comentado.pdf", "plano apresentado_v3.pdf", "Plano_GC.pdf", "plano_de.pdf", "v2.pdf", "plano (1) - Copia.pdf", "nova.pdf")}
    assert stems == {
        "a/Cópia de plano.docx": "plano", "plano_v6_Comentado.pdf": "plano", "plano apresentado_v3.pdf": "plano", "Plano_GC.pdf": "plano", "plano_de.pdf": "plano de", "v2.pdf": "v2",
        "plano (1) - Copia.pdf": "plano", "nova.pdf": "nova",
    }
    assert one(spark, ranking.version, "x_v1/plano_v12.3 v2_1.docx") == [2, 1] and one(spark, ranking.version, "x_v1/plano.docx") is None


def test_hop_puts_neighbours_after_their_hit(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, item string, rank int")
    near = spark.createDataFrame([("a", "x", 1), ("a", "c", 2), ("b", "a", 1), ("c", "y", 1)], "doc string, other string, rank int")
    got = [r.item for r in graph.hop(hits, near, expanded=2, k=5).orderBy("rank").collect()]
    assert got == ["a", "x", "c", "b"]


def test_metrics_and_movements(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "query_id int, item string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (2, "z")], "query_id int, item string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {x.query_id: x for x in evaluation.judge(r, gold, asked, k=3).collect()}
    assert (got[1].recall_all, got[1].reciprocal_rank) == (1.0, 0.5)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert (got[2].recall_any, got[3].n_relevant, got[3].ndcg) == (0, 0, 0.0)


def test_bootstrap_is_repeatable_and_paired(spark):
    a = spark.createDataFrame([(i, float(i % 2)) for i in range(60)], "query_id int, v double")
    b = a.withColumn("v", F.col("v") + 1)
    first, again = (evaluation.paired_delta(a, b, "v").collect() for _ in range(2))
    assert first == again and (first[0]["mean"], first[0].verdict, first[0].n) == (1.0, "better", 60)
    assert evaluation.bootstrap_interval(a.limit(0).withColumn("g", F.lit(1)), "g", "v").count() == 0


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 5.0)], "g string, v double")
    assert {r.g: (r.p50, r.p95) for r in evaluation.nearest_rank(rows, "g", "v", (0.5, 0.95)).collect()} == {"a": (5.0, 10.0), "b": (5.0, 5.0)}


def test_access(spark):
    blocks = spark.createDataFrame([(1, 0, ["A"], "x"), (1, 1, ["A", "B"], "yé"), (1, 2, ["C", "B"], ""), (2, 0, [], "z")], "doc int, n int, trail array<string>, text string")
    rows = access.canonical(blocks, doc="doc", order="n", trail="trail", text="text").orderBy("doc", "n").collect()
    whole = "".join(r.markdown for r in rows if r.doc == 1)
    assert whole == "# A\n\nx\n\n## B\n\nyé\n\n# C\n\n## B\n\n\n\n" and [whole[r.start : r.end] for r in rows[:3]] == ["x", "yé", ""]
    cursor = access.make_cursor("r1", 20)
    assert access.read_cursor(cursor, "r1") == 20
    with pytest.raises(ValueError):
        access.read_cursor(cursor, "r2")
    assert access.revision(blocks, ["doc", "n"]).first() == access.revision(blocks.orderBy(F.col("n").desc()), ["doc", "n"]).first()


def test_deletion_guard():
    assert maintenance.may_delete(9, 10, True) and not maintenance.may_delete(1, 10, False)
    assert not maintenance.may_delete(21, 100, True) and maintenance.may_delete(21, 100, True, force=True) and maintenance.may_delete(20, 100, True)


def test_elo_moves_the_winner_between_losers(spark):
    races = spark.createDataFrame([("l", 1, "a", ["a", "b", "c"]), ("l", 2, "c", ["a"])], "ladder string, n int, w string, l array<string>")
    got = {r.player: r.rating for r in analytics.elo(races, by="ladder", order="n", winner="w", losers="l").collect()}
    assert got["b"] == 1184.0 and sum(got.values()) == pytest.approx(3600)
    gain = round(32 * (1 - 1 / (1 + 10 ** ((1200 - 1216) / 400))), 2)
    assert got["a"] + got["c"] == pytest.approx(1216 + gain + 1200 - gain)


def test_least_squares_never_below_zero(spark):
    rows = spark.createDataFrame([("a", i, float(i), 5.0 + 2.0 * i) for i in range(50)] + [("b", i, float(i), 100.0 - i) for i in range(50)], "g string, n int, x double, y double")
    got = {r.g: (r.intercept, r.slope) for r in analytics.least_squares(rows, by="g", order="n", x="x", y="y").collect()}
    assert got["a"] == (pytest.approx(5, abs=0.01), pytest.approx(2, abs=0.01)) and got["b"][1] == 0.0


def test_skyline_ties(spark):
    rows = spark.createDataFrame([(1, 1.0, 5), (2, 1.0, 5), (3, 2.0, 5), (4, 3.0, 9), (5, 0.0, -1)], "id int, cost double, score int")
    assert [r.id for r in analytics.skyline(rows, "cost", "score").orderBy("cost").collect()] == [5, 1, 4]


def test_debounce_batch_and_stream_agree(spark, tmp_path):
    start = datetime(2024, 1, 1)
    steps = [("a", 0, "create"), ("a", 500, "delete"), ("a", 1300, "create"), ("b", 100, "create"), ("b", 3000, "delete"), ("z", 9_000_000, "end")]
    rows = spark.createDataFrame([(k, start + timedelta(milliseconds=ms), a) for k, ms, a in steps], "path string, ts timestamp, action string")
    batch = {(r.path, r.ts, r.action) for r in analytics.debounce(rows, key="path", at="ts", action="action").collect()}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = changes.quiet_changes(stream, key="path", at="ts", action="action")
    query = out.writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.path, r.ts, r.action) for r in spark.table("quiet").collect()}
    assert got == {x for x in batch if x[0] != "z"}


def test_stream_keeps_a_table_and_restarts(spark, tmp_path):
    schema = "path string, action string, v int"
    for n, part in enumerate([[("a", "create", 1), ("b", "create", 2)], [("a", "delete", 0), ("c", "create", 3)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        changes.keep_table(stream, str(tmp_path / "out"), str(tmp_path / "mark"), key="path", action="action").awaitTermination()
        state = max((tmp_path / "out").glob("state=*"), key=lambda p: int(p.name.split("=")[1]))
        got = {(r.path, r.v) for r in spark.read.parquet(str(state)).collect()}
        assert got == [{("a", 1), ("b", 2)}, {("b", 2), ("c", 3)}][n]


def test_exact_neighbours_of_unequal_lengths(spark):
    items = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0])]
    df = spark.createDataFrame(items, "id long, vector array<double>")
    got = [tuple(r) for r in ranking.exact_neighbours(df, df, k=2, block=2).select("query_id", "rank", "item").orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
