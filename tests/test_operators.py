import hashlib
import json
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill.config import Domain, checked_limit
from glossmill.functions import text as T
from glossmill.functions.vectors import dot, sparse_embedding, unit_length
from glossmill.operators import build, evaluate, evidence, fusion, graph, inverted, knowledge, queries, store, textindex, units, vectorsearch
from glossmill.operators.planner import cited_answers, intents
from glossmill.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.one_spaced(lit(" a\u3000\n b "))) == "a b"
    assert one(spark, T.sentences(lit("一。二 三！四"))) == ["一。", "二三！", "四"]
    assert one(spark, T.quote(lit("一二三四五"), 4)) == "一二三…" and one(spark, T.quote(lit("一 二"), 4)) == "一二"
    assert one(spark, T.longest_terms(lit("大承气汤与承气汤"), ["承气汤", "大承气汤"])) == ["大承气汤", "承气汤"]
    assert one(spark, T.occurrences(lit("aaaa"), lit("aa"))) == 3
    assert one(spark, T.repeated_phrase(lit("脾阳脾阳 脾阳"))) and not one(spark, T.repeated_phrase(lit("脾阳脾阳")))
    assert one(spark, T.followed_safely(lit("木香饼干"), "木香饼", ("干",))) is False
    assert one(spark, T.ngrams(lit("ab𢌱c"))) == ["ab𢌱", "b𢌱c"]
    paths = {"/home/x/a.pdf": "pdfs/a.pdf", "C:\\u\\a.pdf": "pdfs/a.pdf", "./pdfs//a.pdf": "pdfs/a.pdf", "a/../b.pdf": "pdfs/b.pdf", "file%3A%2F%2F%2Fb.pdf": "pdfs/b.pdf", "notes/b.pdf": "notes/b.pdf", "%252525252Fhome%25252Fx%252Fa.pdf": "pdfs/a.pdf", "x%2Fa.pdf": "pdfs/a.pdf", "a+b.pdf": "a+b.pdf", "~me/a.pdf": "pdfs/a.pdf", "s/a.pdf?key=1": "pdfs/a.pdf", "%" + "25" * 9 + "2Fa.pdf": "pdfs/source.pdf", " ": ""}
    for path, want in paths.items():
        assert one(spark, T.public_path(lit(path))) == want, path
    assert one(spark, T.citation(lit("pdfs/a.pdf"), lit(3), lit(4))) == "a.pdf p3-4"
    assert one(spark, T.strip_tags(lit("<p>a<script>x</script> b</p>"))) == "a b"


def test_vectors(spark):
    assert one(spark, dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11
    assert one(spark, unit_length(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, unit_length(F.array(F.lit(0.0)))) == [0.0]
    df = spark.createDataFrame([("a", "云 tea"), ("b", None), ("c", "")], "id string, text string")
    for digest in ("md5", "blake2b"):
        got = sparse_embedding(df, "id", "text", digest=digest).collect()
        assert len(got) == 2 and all(math.isclose(r.value, math.sqrt(0.5)) and r.id == "a" for r in got)
    want = {int(hashlib.blake2b(x.encode(), digest_size=8).hexdigest(), 16) % 2048 for x in ("云", "tea")}
    assert {r.dim for r in got} == want


def test_units(spark):
    text = "".join(f"{i}。" for i in range(1, 12))
    df = spark.createDataFrame([("p", "d", "t", text), ("q", "d", None, "一。"), ("r", "d", None, None)], "paragraph_id string, doc_id string, title string, text string")
    got = units.retrieval_units(df).collect()
    windows = sorted((r.sentence_start, r.sentence_end) for r in got if r.unit_type == "window")
    assert windows == [(0, 0), (0, 5), (4, 9), (8, 10)]
    assert sum(r.unit_type == "sentence" for r in got) == 12 and len({r.unit_id for r in got}) == len(got)
    packed = spark.createDataFrame([(1, "一二三。四五。" + "六" * 900 + "。七。")], "doc_id long, text string")
    assert [len(r.text) for r in units.paragraphs_of(packed).orderBy("seq").collect()] == [7, 901, 2]


def test_bm25_counts_and_order(spark):
    rows = spark.createDataFrame([("a", "白雲草治头痛，白云草", None), ("b", "白云草", "题"), ("c", "无关文字", "头痛"), ("d", None, None), (None, "白云草", None)], "id string, text string, title string")
    index = textindex.build_index(rows, "id", ["title", "text"])
    q = spark.createDataFrame([("q", ["白云草", "头痛"]), ("n", ["没有的"]), ("e", [])], "query_id string, terms array<string>")
    got = {r.row_id: r for r in textindex.bm25(index, q).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].matched == ["头痛", "白云草"] and got["c"].matched == ["头痛"] and got["c"].score == 0
    ranked = {r.row_id: r for r in textindex.text_channel(index, q).collect()}
    assert set(ranked) == {"a", "b", "c"} and (ranked["a"].score, ranked["b"].score, ranked["c"].score) == (0.78, 0.8, 0.58)
    empty = textindex.build_index(rows.limit(0), "id", ["title", "text"])
    assert textindex.text_channel(empty, q).count() == 0


def test_query_terms(spark):
    domain = Domain(vocabularies={"sign": ("头痛", "偏头痛")}, scaffold=("请问", "怎么煎服"), generic=("这个",), script_pairs="頭头 雲云")
    asked = {
        "a": "请问白雲草 Tea 偏頭痛怎么煎服", "b": "头痛与偏头痛，用10 克白云草？", "c": "这个白云草花", "d": "", "e": "一二三四五六七八九", "f": "頭痛的", "g": "x",
    }
    q = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    lexicon = spark.createDataFrame([("白云草",), ("白云草花",), (None,)], "term string")
    got = {r.query_id: r.terms for r in queries.query_terms(q, lexicon, domain).collect()}
    assert got["a"] == ["偏头痛", "白云草", "tea"]
    assert got["b"] == ["偏头痛", "白云草", "头痛", "10克", "10"]
    assert got["c"] == ["白云草花"] and got["d"] == [] and got["f"] == ["头痛"] and got["g"] == []
    assert got["e"] == ["一二三", "二三四", "三四五", "四五六", "五六七", "六七八", "七八九"]
    assert one(spark, queries.useful_terms(F.array(F.lit("12"), F.lit("x"), F.lit("所以"), F.lit("白云")))) == ["白云"]
    assert one(spark, T.script_variants(F.lit("头云"), domain.scripts)) == ["頭雲"] and one(spark, T.script_variants(F.lit("里"), ("裡裏", "里里"))) == ["裡", "裏"]


def test_evidence(spark):
    lit, arr = F.lit, lambda *x: F.array(*map(F.lit, x))
    text = "白云草治头痛。另有一句很长的话不相干！霜花治腹胀。"
    assert one(spark, evidence.anchor_snippet(lit(text), arr("白云草", "头痛"))) == "白云草治头痛。"
    assert one(spark, evidence.anchor_snippet(lit(text), arr("白云草", "腹胀"))) == "白云草治头痛。 霜花治腹胀。"
    pair = "甲一二三四五六七八。乙一二三四五六七八。"
    assert one(spark, evidence.anchor_snippet(lit(pair), arr("甲", "乙"), most=12)) == pair[:12]
    assert one(spark, evidence.anchor_snippet(lit("甲" + "一" * 50 + "乙"), arr("甲", "乙"), most=15)) == "甲一一一一一 … 一一一一一乙"
    assert one(spark, evidence.anchor_snippet(lit(text), arr("没有"))) == "" and one(spark, evidence.anchor_snippet(lit("甲乙丙丁"), arr("甲乙丙丁"), most=2)) is None
    assert one(spark, evidence.literal_snippet(lit(text), arr("没有", "腹胀"))) == "霜花治腹胀。" and one(spark, evidence.literal_snippet(lit("一" * 300 + "腹胀"), arr("腹胀"), most=6)) == "一一一一腹胀"
    assert one(spark, evidence.verified_quotes(lit(text), arr(" 霜花治腹胀 ", "霜花治腹胀", "没有", ""))) == ["霜花治腹胀"]
    assert one(spark, fusion.merge_unique(arr("b", "a"), arr("a", "c"))) == ["b", "a", "c"]


def test_build_store(spark, tmp_path):
    pages = spark.createDataFrame([("x/a.pdf", 1, "12\n\n白云汤主头顶胀满，每次用三两五克。不可久服，误服则吐。\n\n短"), ("x/a.pdf", 2, "短页"), ("x/b.pdf", 1, None)], "source_path string, page int, text string")
    p = units.paragraphs_of_pages(pages)
    assert sorted((r.page_start, r.text) for r in p.collect()) == [(1, "白云汤主头顶胀满，每次用三两五克。不可久服，误服则吐。"), (2, "短页")]
    out = str(tmp_path / "store")

    def make():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    counts = build.build_store(p, out, make=make, dims=2, traces=str(tmp_path / "traces"))
    assert counts["paragraphs"] == 2 and counts["unit_types"] == 4 and counts["knowledge_units"] > 0
    u = spark.read.parquet(f"{out}/retrieval_units")
    before = u.count()
    assert u.filter("size(vector) = 2").count() == u.count() == counts["retrieval_units"]
    questions = u.filter("unit_type = 'question'").count()
    assert build.augment_questions(out, spark, make=make, dims=2) == questions and spark.read.parquet(f"{out}/retrieval_units").count() == before
    config = json.loads((tmp_path / "traces" / "build_config.json").read_text())
    assert config["n_paragraphs"] == 2 and config["n_build_events"] == 1
    with pytest.raises(Exception, match="components"):
        build.embedded(p, "text", make, 3).collect()
    with pytest.raises(ValueError, match="unknown unit types"):
        units.checked_types("sentence, verse")
    assert units.checked_types("window,sentence") == ("window", "sentence") and len(units.checked_types(None)) == 4
    merged = build.upsert(p.withColumn("at", F.lit(1)), p.withColumn("at", F.lit(2)), "paragraph_id", "at")
    assert {r.at for r in merged.collect()} == {2}


def test_written_tables_can_be_removed(spark, monkeypatch):
    from glossmill import session

    monkeypatch.setattr(session, "_WRITTEN", [])
    kept = session.written(spark.range(3))
    assert kept.count() == 3 and session.remove_written(spark) == 1 and session.remove_written(spark) == 0
    made = []

    def build():
        made.append(session.written(spark.range(len(made) + 1)))
        return made[-1]

    assert session.stored(spark, ("t",), build).count() == session.stored(spark, ("t",), build).count() == 1
    assert session.remove_written(spark) == 1 and session.stored(spark, ("t",), build).count() == 2 and len(made) == 2


def test_lines_are_numbered_through_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(1, 401)) + "\n")
    (tmp_path / "b.txt").write_text("only\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(rows) == 401 and all(r.value in (f"line {r.line}", "only") for r in rows) and [r.line for r in rows if r.value == "only"] == [1]


def test_chain_of_a_hot_document(spark):
    rows = [(f"e{i:03d}", None if i == 150 else "hot" if i % 3 else f"d{i % 7}", i // 2) for i in range(200)]
    df = spark.createDataFrame(rows, "evidence_id string, document_id string, at int").withColumn("recorded_at", F.timestamp_seconds("at"))
    got = {r.evidence_id: (r.previous_id, r.next_id) for r in store.chain(df, 7).collect()}
    want = {}
    for doc in {d for _, d, _ in rows}:
        ids = [e for e, d, a in sorted(rows, key=lambda r: (r[2], r[0])) if d == doc]
        want |= {e: (ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None) for k, e in enumerate(ids)}
    assert got == want
    audit = spark.createDataFrame([("a", "ok", 0, None), ("b", "warning", 1, "x")], "code string, status string, n long, example string")
    assert [(r.status, r.n) for r in store.overall(audit).filter("code = 'overall'").collect()] == [("warning", 1)]


def channel(spark, rows):
    return spark.createDataFrame([("q", r, s, k) for r, s, k in rows], "query_id string, row_id string, score double, rank int")


def test_fusion_ties_duplicates_and_weights(spark):
    text = channel(spark, [("x", 99.0, 1), ("shared", 0.1, 2), ("shared", 0.1, 3)])
    vector = channel(spark, [("y", 0.9, 1), ("shared", 0.2, 2)])
    got = fusion.fuse_channels({"text": text, "vector": vector}, 10).orderBy("rank").collect()
    assert [r.row_id for r in got] == ["shared", "x", "y"]
    assert math.isclose(got[0].fusion_score, 2 / 62) and got[0].channel_ranks == {"text": 2, "vector": 2}
    low = fusion.fuse_channels({"text": text, "vector": vector}, 1, {"text": 0.1}).first()
    assert low.row_id == "shared"
    runs = spark.createDataFrame([("q", 0, "a", 1.0, 1), ("q", 1, "a", 3.0, 2), ("q", 1, "b", 2.0, 1)], "query_id string, rewrite int, row_id string, score double, rank int")
    first = fusion.fuse_rewrites(runs, 5).orderBy("rank").first()
    assert first.row_id == "a" and first.raw_score == 3.0 and (first.rewrite, first.place) == (1, 2) and [tuple(x) for x in first.seen] == [(0, 1, 1.0), (1, 2, 3.0)]


def test_diversity(spark):
    rows = [("q", "a", 1.0, "s", ["x"]), ("q", "b", 0.95, "s", ["x"]), ("q", "c", 0.92, "s", ["y", "z"]), ("q", "e", 0.9, "t", ["x"]), ("q", "d", 0.1, None, None), ("r", "b", 0.5, "s", None), ("r", "a", 0.7, "s", [])]
    df = spark.createDataFrame(rows, "query_id string, row_id string, score double, source string, facets array<string>")
    got = fusion.diverse(df, 3).orderBy("query_id", "pick").collect()
    assert [(r.query_id, r.row_id) for r in got] == [("q", "a"), ("q", "c"), ("q", "e"), ("r", "a"), ("r", "b")]


def test_metrics_example(spark):
    cases = spark.createDataFrame([("c", ["p2", "p4"], ["p8"]), ("none", [], None), ("unseen", ["p1"], [])], "case_id string, relevant array<string>, forbidden array<string>")
    ranking = spark.createDataFrame([("c", r, i + 1) for i, r in enumerate(["p8", "p2", "p3", "p4", "p2"])], "case_id string, row_id string, rank int")
    got = {(r.case_id, r.metric): r.value for r in evaluate.ranked_metrics(cases, ranking, (1, 3, 5)).collect()}
    c = {m: v for (case, m), v in got.items() if case == "c"}
    assert (c["hit@1"], c["recall@3"], c["recall@5"], c["reciprocal_rank"], c["forbidden@5"], c["precision@5"]) == (0, 0.5, 1, 0.5, 1, 0.5)
    assert math.isclose(c["ndcg@5"], (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert got["none", "recall@1"] == 1 and got["none", "hit@1"] == 0 and got["unseen", "recall@5"] == 0
    mean = {r.metric: r.value for r in evaluate.mean_metrics(evaluate.ranked_metrics(cases, ranking, (5,))).collect()}
    assert math.isclose(mean["recall@5"], 2 / 3)


def test_exact_search(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], 1.0), ("b", [0.8, 0.6], 1.15), ("c", [-1.0, 0.0], 1.0), ("d", None, 1.0), ("e", [1.0, 0.0], None)], "row_id string, vector array<double>, weight double")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [r.row_id for r in vectorsearch.exact_top(rows, q, 3).orderBy("rank").collect()] == ["a", "e", "b"]
    assert vectorsearch.exact_top(rows, q.limit(0), 3).count() == 0
    hits = spark.createDataFrame([("q", "u1", "p", "sentence", 0.5), ("q", "u2", "p", "window", 0.6), ("q", "u3", "r", "sentence", 0.61)], "query_id string, unit_id string, paragraph_id string, unit_type string, score double")
    top = vectorsearch.hits_to_paragraphs(hits, 2).orderBy("rank").collect()
    assert [r.paragraph_id for r in top] == ["p", "r"] and math.isclose(top[0].score, 0.64) and top[0].unit_ids == ["u2", "u1"]


def test_extraction_and_guide(spark):
    p = spark.createDataFrame([("p", "d", "白云汤主头顶胀满，用三两5克。不可久服。"), ("q", "d", None)], "paragraph_id string, doc_id string, text string")
    got = {r.unit_type: r for r in knowledge.extract(p).collect()}
    assert got["dosage"].object == "5克" and got["caution"].evidence_quote == "不可久服。" and "formula_pattern" in got
    assert got["formula_pattern"].subject == "白云汤"
    known = knowledge.extract(p).withColumn("source_path", F.lit("x/书.pdf")).withColumn("page_start", F.lit(3))
    nodes = knowledge.guide_nodes(known, p.withColumn("source_path", F.lit("x/书.pdf")).withColumn("page_start", F.lit(3)), {"dosage": ("dose", "D")}, ("formula", "F")).collect()
    assert {n.badge for n in nodes} == {"D", "other", "F"} and {n.path for n in nodes if n.badge == "F"} == {"书.pdf p3 > F > 白云汤"}


def test_graph_takes_accepted_relations_with_living_evidence(spark):
    ent = spark.createDataFrame([("e1", "key"), ("e2", None)], "entity_id string, normalized_key string")
    rel = spark.createDataFrame([(f"r{i}", s, "e1", ev, c) for i, (s, ev, c) in enumerate([("auto_accepted", "V1", 0.9), ("rejected", "v1", 0.9), ("needs_review", "v1", 0.9), ("reviewed", " v1", None), ("reviewed", "dead", 1.0), ("reviewed", None, 1.0)])], "relation_id string, review_status string, subject_entity_id string, evidence_id string, confidence double").withColumn("recorded_at", F.lit(None).cast("timestamp"))
    ev = spark.createDataFrame([("v1", "p", None), ("dead", "p", 1), ("lost", "none", None)], "evidence_id string, paragraph_id string, d int").withColumn("recorded_at", F.lit(None).cast("timestamp")).withColumn("deleted_at", F.when(F.col("d") == 1, F.current_timestamp()))
    p = spark.createDataFrame([("P ",)], "paragraph_id string")
    nav = graph.relation_paragraphs(ent, rel, ev, p)
    assert sorted(r.relation_id for r in nav.collect()) == ["r0", "r3"]
    q = spark.createDataFrame([("q", "key")], "query_id string, entity_key string")
    top = graph.graph_channel(nav, q).first()
    assert (top.paragraph_id, top.n_relations, top.score) == ("p", 2, 0.9)


def test_store(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", None, "n"), (None, 1, "w")], "k string, v int, t string")
    assert {(r.k, r.t) for r in store.latest(df, "k", "v").collect()} == {("a", "y"), ("b", "n")}
    units_ = spark.createDataFrame([("u1",), ("u2",)], "unit_id string")
    mapping = spark.createDataFrame([("u1",), ("u1",), ("ghost",)], "unit_id string")
    got = {r.code: (r.status, r.n, r.example) for r in store.audit_ids(units_, mapping).collect()}
    assert got == {"duplicate_ids": ("error", 1, "u1"), "unknown_ids": ("error", 1, "ghost"), "missing_ids": ("error", 1, "u2")}


def test_answers_quote_paragraphs(spark):
    q = spark.createDataFrame([("q", "白云草的用量是多少？", ["白云草"])], "query_id string, query string, terms array<string>")
    found = spark.createDataFrame([("q", "p", 1.0, 1)], "query_id string, row_id string, score double, rank int")
    p = spark.createDataFrame([("p", "/x/讲.pdf", 3, 3, "前一句。白云草五克。")], "paragraph_id string, source_path string, page_start int, page_end int, text string")
    r = cited_answers(q, found, p).first()
    assert (r.intent, r.answer, r.citations) == ("dosage", "白云草五克。 [1]", "[1] 讲.pdf p3")
    assert one(spark, intents(F.lit("甲与乙如何区分"))) == "comparison"


def test_limits():
    for bad in (True, 1.5, "3"):
        with pytest.raises(TypeError):
            checked_limit(bad)
    for bad in (0, -1, 101):
        with pytest.raises(ValueError):
            checked_limit(bad)


def test_files(spark, tmp_path):
    good = {"case_id": "c", "query": "q", "task_type": "t", "relevant_paragraph_ids": ["p"]}
    lines = [json.dumps(good), "not json", json.dumps(good | {"relevant_paragraph_ids": []}), json.dumps(good | {"forbidden_paragraph_ids": ["p"]}), ""]
    (tmp_path / "cases.jsonl").write_text("\n".join(lines))
    cases, problems = files.case_problems(spark, str(tmp_path / "cases.jsonl"))
    assert cases.count() == 1 and {(r.line, r.problem.split()[0]) for r in problems.collect()} == {(2, "not"), (3, "no"), (4, "a")}
    n = files.write_lines(spark.createDataFrame([("u2",), ("u1",)], "unit_id string"), str(tmp_path / "map"))
    assert n == 2 and {r.unit_id for r in files.read_mapping(spark, str(tmp_path / "map")).collect()} == {"u1", "u2"}
    (tmp_path / "bad.jsonl").write_text('{"unit_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_mapping(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "b.PDF").write_bytes(b"one\fTwo")
    pages = files.page_files(spark, str(tmp_path), lambda data: data.decode().split("\f")).orderBy("page").collect()
    assert [(r.page, r.text) for r in pages] == [(1, "one"), (2, "Two")]
    meta = spark.createDataFrame([("a", "1"), ("b", "x" * 5000)], "key string, value string")
    assert files.settings(meta, ["a", "b"]) == {"a": "1", "b": None}


def test_streamed_ingest_equals_batch(spark, folder, tmp_path):
    from glossmill.plans.common import paragraphs
    from glossmill.streaming.ingest import arrivals_per_hour, ingest, paragraph_stream

    source = tmp_path / "in"
    spark.read.parquet(f"{folder}/paragraphs.parquet").write.parquet(str(source))
    ingest(paragraph_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("unit_id").distinct()
    want = units.retrieval_units(paragraphs(spark, folder)).select("unit_id").distinct()
    assert want.subtract(got).count() == 0
    counts = arrivals_per_hour(paragraph_stream(spark, str(source)))
    counts.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("hours").agg(F.sum("n_paragraphs")).first()[0] > 0


def test_text_channel_scores_terms_past_the_candidates(spark):
    terms = ["白云草", "头痛发", "青木香", "石上泉"]
    rows = [(f"s{t}{i:02d}", term * 3) for t, term in enumerate(terms) for i in range(20)] + [("long", "".join(terms) + "字" * 6000)]
    rows = spark.createDataFrame(rows, "id string, text string")
    q = spark.createDataFrame([("q", terms)], "query_id string, terms array<string>")
    first = textindex.text_channel(textindex.build_index(rows, "id", ["text"]), q, 10, candidates=50).filter("rank = 1").collect()
    assert [(r.row_id, round(r.score, 6)) for r in first] == [("long", 0.94)]


def test_sparse_search_equals_all_products(spark):
    texts = ["白云草治头痛", "头痛 Tea", "白云草白云草", None, "", "青木香治头痛发热 tea tea", "头痛 tea", "石上泉。" * 40]
    rows = spark.createDataFrame([(f"u{i % 8}{i // 8}", f"p{i % 5}", "sentence", None if i % 3 else 0.5 + i % 4, texts[i % 8]) for i in range(48)], "unit_id string, paragraph_id string, unit_type string, weight double, text_for_embedding string")
    q = spark.createDataFrame([("a", "白云草与头痛"), ("b", "tea"), ("c", "白云草与头痛"), ("d", "。"), ("e", None)], "query_id string, query string")
    vectors = vectorsearch.sparse_units(rows)
    assert vectors.columns == ["row_id", "paragraph_id", "unit_type", "weight", "dims", "counts"]
    got = sorted((r.query_id, r["rank"], r.unit_id, round(r.score, 9)) for r in vectorsearch.sparse_top(vectors, q, 7).collect())
    u, x = (sparse_embedding(df, key, text) for df, key, text in ((rows, "unit_id", "text_for_embedding"), (q, "query_id", "query")))
    product = u.withColumnRenamed("value", "v").join(x, "dim").groupBy("query_id", "unit_id").agg(F.sum(F.col("v") * F.col("value")).alias("s")).join(rows, "unit_id")
    all_ = [(r.query_id, round(r.s * (1.0 if r.weight is None else r.weight), 9), r.unit_id) for r in product.collect()]
    want = []
    for one in "abc":
        mine = sorted((-s, unit) for query, s, unit in all_ if query == one)[:7]
        want += [(one, i + 1, unit, -s) for i, (s, unit) in enumerate(mine)]
    assert got == want


def brute_text_channel(rows, terms, limit, candidates):
    """The text channel of one query over {row_id: text}, written out."""
    asked = {t for t in terms if len(t) >= 2}
    tf = {r: {t: n for t in asked if (n := sum(x.startswith(t, i) for i in range(len(x))))} for r, x in rows.items()}
    size = {r: max(0, len(x) - 2) for r, x in rows.items()}
    mean = sum(size.values()) / len(size)
    idf = {t: max(1e-6, math.log((len(rows) - (df := sum(t in f for f in tf.values())) + 0.5) / (df + 0.5))) if len(t) > 2 else 0.0 for t in asked}
    score = {r: sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[r] / mean)) for t, n in f.items()) for r, f in tf.items() if f}
    n = min(candidates, sum(s > 0 for s in score.values()))
    merged = []
    for place, r in enumerate(sorted(score, key=lambda r: (-round(score[r], 9), r))):
        rank = 0.45 + 0.35 * (1 - place / n) if place < candidates and score[r] > 0 else 0.0
        merged.append((-round(min(1.0, max(rank, 0.5 + 0.08 * len(tf[r]) + 0.12 * (len(tf[r]) == len(terms)))), 9), r))
    return [(r, -s) for s, r in sorted(merged)[:limit]]


def test_only_the_best_rows_leave_a_task(spark):
    words = ["白云草", "头痛", "青木香", "石上泉", "发热", "tea", "草头痛", "白云"]
    texts = {f"r{i:03d}": "".join(words[(i * k + k) % 8] * (1 + i % k % 3) for k in range(1, 2 + i % 7)) + "字" * (i % 11) for i in range(400)}
    index = textindex.build_index(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", ["text"])
    asked = {"a": words, "b": ["头痛", "白云"], "c": words[:3], "d": ["发热", "没有的"], "e": words[:3], "f": ["x"], "g": []}
    q = spark.createDataFrame(list(asked.items()), "query_id string, terms array<string>")
    per = {r.query_id: r["count"] for r in textindex.found_rows(index, q, 3, 5).groupBy("query_id").count().collect()}
    assert set(per) == set("abcde") and max(per.values()) <= 8 * spark.sparkContext.defaultParallelism < sum("头痛" in x for x in texts.values())
    for limit, candidates in ((5, 200), (7, 3), (60, 20)):
        got = {}
        for r in textindex.text_channel(index, q, limit, candidates).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.row_id, r.score))
        for one, terms in asked.items():
            assert got.get(one, []) == brute_text_channel(texts, terms, limit, candidates), (one, limit)


def test_guide_search_equals_all_pairs(spark):
    words = ["白云汤", "头痛", "青木散", "石上泉", "发热", "口干", "腹胀", "恶寒", "盗汗", "心悸", "水肿", "咳嗽"]
    nodes = [(f"n{i:03d}", "formula" if i % 3 else "note", f"b{i % 4}", words[i * 7 % 12] if i % 5 else "汤", "p" * (i % 6), "".join(words[(i * k + k * k) % 12] for k in range(1, 2 + i % 6))) for i in range(300)]
    frame = spark.createDataFrame(nodes, "node_id string, node_type string, badge string, label string, path string, search_text string")
    asked = {"a": ("白云汤治头痛吗", words), "b": ("发热", ["发热"]), "c": ("没有", ["没有的"]), "d": ("腹胀恶寒", words[5:8] + ["石上泉", "白云汤"])}
    q = spark.createDataFrame([(k, x, t) for k, (x, t) in asked.items()], "query_id string, query string, terms array<string>")
    index = knowledge.guide_index(frame)
    ranked = {}
    for r in textindex.bm25(index, q.withColumn("terms", F.slice("terms", 1, 12))).collect():
        ranked.setdefault(r.query_id, []).append((-round(r.score, 9), r.row_id))
    got = {}
    for r in knowledge.guide_scores(index, frame, q, ("formula", "b1"), 8).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.node_id, r.score))
    for one, (text, terms) in asked.items():
        part = {n: 1 / (1 - s) for s, n in sorted(ranked.get(one, []))[:32] if s < 0}
        scored = []
        for n, kind, badge, label, path, said in nodes:
            held = sum(t in said for t in terms[:8])
            if held or n in part:
                scored.append((-round(held + part.get(n, 0) + 20 * (label in text) + 5 * (kind == "formula") + 3 * (badge == "b1"), 9), -len(path), n, (badge, label)))
        want, seen = [], set()
        for s, _, n, group in sorted(scored):
            if group not in seen:
                seen.add(group)
                want.append((n, -s))
        assert got.get(one, []) == want[:8], one
    asks = knowledge._labels_in(["汤", "", "白云", "白云汤", "云汤x"])
    assert sorted(asks("用白云汤")) == [0, 2, 3] and asks("云") == []


def test_each_wide_channel_runs_once_for_all_modes(spark, folder, monkeypatch):
    from glossmill.plans import retrieval

    ran, channel_of = [], retrieval._channel
    monkeypatch.setattr(retrieval, "_channel", lambda s, f, mode, q, n: ran.append(mode) or channel_of(s, f, mode, q, n))
    assert set(retrieval.k7_search(spark, folder).columns) == {"mode", "query_id", "paragraph_id", "rank"}
    assert sorted(ran) == ["graph", "graph", "knowledge", "text", "vector"]


def test_knowledge_search_equals_all_pairs(spark):
    words = ["白云汤", "头痛", "青木散", "石上", "发热", "口干"]
    rows = [(f"k{i:03d}", f"p{i * 7 % 40:02d}" if i % 50 else None, f"d{i % 3}" if i % 11 else None, i % 4 or None, "dosage" if i % 5 else "caution", "".join(words[(i * k + k) % 6] for k in range(1, 2 + i % 4))) for i in range(500)]
    units_ = spark.createDataFrame(rows, "knowledge_unit_id string, paragraph_id string, doc_id string, page_start int, unit_type string, subject string")
    units_ = units_.withColumns({c: F.lit(None).cast("string") for c in ("predicate", "object", "evidence_quote")})
    asked = {"a": words, "b": ["白云汤"], "c": ["头痛", "石上"], "d": ["没有的"], "e": ["白云汤"]}
    q = spark.createDataFrame(list(asked.items()), "query_id string, terms array<string>")
    index = knowledge.knowledge_index(units_)
    for limit in (None, 4):
        got = {}
        for r in knowledge.knowledge_scores(index, units_, q, limit).collect():
            got.setdefault(r.query_id, []).append((-round(r.score, 9), r.paragraph_id or "", r.n_units))
        for one, terms in asked.items():
            held = [(r, [t for t in terms if t in r[5]]) for r in rows]
            held = [(r, t) for r, t in held if t]
            full = sorted((r[2] is not None, r[2] or "", r[3] is None, r[3] or 0, r[0]) for r, t in held if any(len(x) > 2 for x in t))
            place = {x[-1]: i for i, x in enumerate(full[:200])}
            want = {}
            for r, t in held:
                s = 0.62 + 0.08 * len(t) + 0.14 * (len(t) == len(terms)) + 0.08 * (r[4] == "dosage")
                s = max(s, 0.55 + 0.25 * (1 - place[r[0]] / min(200, len(full))) if r[0] in place else 0)
                best, n = want.get(r[1] or "", (0, 0))
                want[r[1] or ""] = (max(best, s), n + 1)
            want = sorted((-round(s, 9), p, n) for p, (s, n) in want.items())
            assert sorted(got.get(one, []))[: limit or 999] == want[: limit or 999], (one, limit)


def test_equal_queries_are_asked_once():
    from glossmill.operators.inverted import Asked, first_best

    asked = Asked(["a", "b", "c", "d"], [(2, 5, 7), (3, 5, 7), (2, 5, 7), ()])
    assert asked.keys == [(2, 5, 7), (3, 5, 7), ()] and asked.ids == [["a", "c"], ["b"], ["d"]]
    assert [b.ids for b in asked.blocks(4)] == [[["a", "c"]], [["b"], ["d"]]] and Asked([], []).blocks() == []
    assert sorted(first_best(vectorsearch.np.array([1.0, 3.0, 2.0, 2.0, 2.0]), 3)) == [1, 2, 3]


def test_sums_of_counts_find_the_best_rows_of_a_task(monkeypatch):
    rng = random.Random(3)
    for name, value in (("FIRST", 6), ("ROWS", 16), ("DEPTH", 3)):
        monkeypatch.setattr(vectorsearch, name, value)
    for k in (1, 5, 200):
        rows = [Counter(rng.choices(range(12), k=rng.choice([1, 3, 9, 400]))) for _ in range(150)]
        weight = [rng.choice([1.0, 0.5, 1.3, 0.0, -1.0]) for _ in rows]
        asked = inverted.Asked([f"q{i}" for i in range(40)], [tuple(sorted(rng.choices(range(14), k=rng.choice([1, 4, 30, 300])))) for _ in range(40)])
        dims, counts = (pa.array([list(f(x)) for x in rows], pa.list_(pa.int32())) for f in (Counter.keys, Counter.values))
        batch = pa.RecordBatch.from_arrays([pa.array([f"u{i:03d}" for i in range(150)]), pa.array(weight), dims, counts], ["row_id", "weight", "dims", "counts"])
        got = {}
        for x in vectorsearch._sparse_search(asked, k)(iter([batch.slice(0, 70), batch.slice(70)])):
            for q, row, score in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True):
                got.setdefault(q, []).append((-round(score, 8), row))
        for keys, (one, *_) in zip(asked.keys, asked.ids, strict=True):
            q = Counter(keys)
            size = lambda c: math.sqrt(sum(n * n for n in c.values()))
            all_ = [(-round(w * sum(n * x[d] for d, n in q.items()) / size(q) / size(x), 8), f"u{i:03d}") for i, (x, w) in enumerate(zip(rows, weight, strict=True))]
            assert sorted(got.get(one, []))[:k] == sorted(x for x in all_ if x[0] < 0)[:k]


def test_rows_with_great_counts_are_summed_together(monkeypatch):
    made = []

    class Counted(vectorsearch._Counts):
        def __init__(self, rows, *rest):
            made.append(len(rows))
            super().__init__(rows, *rest)

    for name, value in (("FIRST", 16), ("ROWS", 16), ("_Counts", Counted)):
        monkeypatch.setattr(vectorsearch, name, value)
    n = 96
    counts = [200 if i % 16 == 0 else 1 for i in range(n)]  # one such row a block
    batch = pa.RecordBatch.from_arrays([pa.array([f"u{i:03d}" for i in range(n)]), pa.array([1.0] * n), pa.array([[1, 2]] * n), pa.array([[c, 1] for c in counts])], ["row_id", "weight", "dims", "counts"])
    out = list(vectorsearch._sparse_search(inverted.Asked(["q"], [(1, 2)]), 5)(iter([batch])))
    assert made == [15] * 6 + [6]
    best = sorted((-round(s, 9), r) for x in out for r, s in zip(x.column("row_id").to_pylist(), x.column("score").to_pylist(), strict=True))[:5]
    assert best == [(-1.0, f"u{i:03d}") for i in range(1, 6)]


def test_rows_that_reach_a_score_are_found():
    rng = vectorsearch.np.random.default_rng(4)
    for n, most in ((1, 9), (500, 9), (3000, 900)):
        share = rng.uniform(0.01, 1.2, n)
        counts = vectorsearch._Counts(vectorsearch.np.arange(n), share, *(vectorsearch.np.zeros(n, int),) * 3, 1)
        total = rng.integers(0, most, n).astype(vectorsearch._small(most))
        for least in (-1.0, 0.5, 5.0, 9.0, 1e6):
            near = counts.reaching(total, least).tolist()
            assert set(vectorsearch.np.flatnonzero((total * share >= least) & (total > 0))) <= set(near)
            assert all(total[i] * share[i] >= least * 0.98 or total[i] == vectorsearch.np.iinfo(total.dtype).max for i in near)


def test_texts_are_not_shuffled_by_place(spark):
    texts = spark.createDataFrame([("a", "白云草白云")], "query_id string, norm string")
    phrases = spark.createDataFrame([("term", "白云"), ("term", "白云草"), ("glue", "云")], "kind string, phrase string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        places = queries.phrase_places(texts, phrases)
        assert "SortMergeJoin" not in places._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.phrase, r.start) for r in places.collect()) == [("白云", 1), ("白云", 4), ("白云草", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mean_metrics_are_over_every_case_and_unit(spark, folder, monkeypatch):
    from glossmill.plans import common, retrieval

    monkeypatch.setattr(retrieval, "JUDGED", 40, raising=False)
    got = {r.metric: r.value for r in retrieval.e2_mean_metrics(spark, folder).filter("channel = 'text'").collect()}
    units = common.knowledge_units(spark, folder).select(F.col("knowledge_unit_id").alias("case_id"), F.concat_ws(" ", "object", "subject").alias("query"), F.array("paragraph_id").alias("relevant"), F.array().cast("array<string>").alias("forbidden"))
    cases = common.judged(spark, folder, all_cases=True).withColumnRenamed("query_id", "case_id").join(units, "case_id", "left_anti").unionByName(units)
    asked = cases.select(F.col("case_id").alias("query_id"), "query")
    found = textindex.text_channel(common.text_index(spark, folder), asked.join(queries.query_terms(asked, common.lexicon(spark, folder)), "query_id"))
    want = evaluate.mean_metrics(evaluate.ranked_metrics(cases, found.select(F.col("query_id").alias("case_id"), "row_id", "rank")))
    assert cases.count() > retrieval.JUDGED and got == {r.metric: pytest.approx(r.value, abs=1e-6) for r in want.collect()}


def test_passing_tables_are_deleted_and_stored_ones_kept(spark):
    from pathlib import Path

    from glossmill import session

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = set(session._WRITTEN), spark.conf.get(setting, None)
    with session.passing(spark):
        session.written(spark.range(3))
        kept = session.stored(spark, ("a test of passing",), lambda: session.written(spark.range(3)))
        paths = [Path(p.removeprefix("file://")) for p in session._WRITTEN if p not in before]
    assert [p.exists() for p in paths] == [False, True] and kept.count() == 3
    assert len(set(session._WRITTEN) - before) == 1 and spark.conf.get(setting, None) == was


def test_queries_split_among_tasks_find_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(f"u{i}", f"p{i % 9}", "sentence", 1.0, "白云草治头痛青木香"[i % 7 :] + "石上泉"[: i % 4]) for i in range(60)], "unit_id string, paragraph_id string, unit_type string, weight double, text_for_embedding string")
    q = spark.createDataFrame([(f"q{i}", "白云草头痛石上泉"[i % 5 :] * (1 + i % 3)) for i in range(30)], "query_id string, query string")
    vectors, split, real = vectorsearch.sparse_units(rows), [], inverted.Asked.blocks
    monkeypatch.setattr(inverted.Asked, "blocks", lambda asked, most: split.append(real(asked, most)) or split[-1])
    got = []
    for many in (vectorsearch.MANY, 1):
        monkeypatch.setattr(vectorsearch, "MANY", many)
        got.append(sorted((r.query_id, r["rank"], r.unit_id, r.score) for r in vectorsearch.sparse_top(vectors, q, 7).collect()))
    assert len(split[0]) == 1 < len(split[1]) <= spark.sparkContext.defaultParallelism // 2 and got[0] == got[1] and got[0]
