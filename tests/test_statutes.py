"""Hand-written statutes and texts with expected rows."""

import json

import pytest

from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import hierarchy, ordering, records


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_clean_text(spark):
    cases = {
        "① 사람을 살해한 자는 사형에 처한다.": "사람을 살해한 자는 사형에 처한다",
        "⑳제1항": "제1항",
        "9. 제1호": "제1호",
        "10. 제10호": "10. 제10호",  # the ordinal pattern knows no zero
        "본문 <개정 2020. 1. 2., 2021.3.4>": "본문",
        "본문 <개정 1995.12.29>": "본문",
        "본문 <신설 2016. 1. 6.>": "본문",
        "제5조 삭제<2016. 1. 6.>": "제5조 삭제",
        "「형법」 제1조, 제2조": "형법 제1조 제2조",
        "　 본문.  ": "본문",
        "본문. <개정 2020. 1. 2>": "본문",
        "가. 나.": "가. 나",
    }
    df = spark.createDataFrame(list(cases.items()), ["raw", "expected"])
    for row in df.select("raw", "expected", tx.clean_text("raw").alias("got")).collect():
        assert row["got"] == row["expected"], row


def test_strip_knows_unicode_white_space(spark):
    assert one(spark, tx.strip("t"), t="  　  a  b 　") == "a  b"


ARTICLES = [
    {"조문번호": "1", "조문키": "0001000", "조문내용": "제1편 총칙"},
    {"조문번호": "1", "조문키": "0001001", "조문내용": "제1조(범죄) ① 본문.", "항": [
        {"항내용": "① 첫째.", "호": [{"호내용": "1. 가"}, {"호내용": "2. 나"}]},
        {"항내용": "② 둘째."},
    ]},
    {"조문번호": "2", "조문키": "0002000", "조문내용": "제3장 형"},
    {"조문번호": "2", "조문가지번호": "2", "조문키": "0002021", "조문내용": "제2조의2 삭제<2016. 1. 6.>"},
    {"조문번호": "3", "조문키": "0003001", "조문내용": "제3조", "항": {"호": [{"호내용": "1. 다"}]}},
    {"조문번호": "4", "조문키": "0004000", "조문내용": "제2편 각칙"},
    {"조문번호": "4", "조문가지번호": "", "조문키": "0004001", "조문내용": "제4조"},
]


def statutes(spark, articles=ARTICLES):
    rows = [("형법", i, json.dumps(a, ensure_ascii=False)) for i, a in enumerate(articles)]
    return spark.createDataFrame(rows, "law_id string, seq long, doc string")


def test_clause_table(spark):
    table = hierarchy.clause_table(statutes(spark), "law_id", "seq")
    got = [
        tuple(r)
        for r in table.orderBy("seq", "paragraph", "subparagraph").select(
            "preamble", "part", "chapter", "article", "article_branch", "paragraph", "subparagraph", "content"
        ).collect()
    ]
    assert got == [
        (1, 1, 0, 1, 1, 0, 0, "제1편 총칙"),
        (0, 1, 0, 1, 1, 0, 0, "제1조(범죄) ① 본문"),
        (0, 1, 0, 1, 1, 1, 0, "첫째"),
        (0, 1, 0, 1, 1, 1, 1, "가"),
        (0, 1, 0, 1, 1, 1, 2, "나"),
        (0, 1, 0, 1, 1, 2, 0, "둘째"),
        (1, 1, 3, 2, 1, 0, 0, "제3장 형"),
        (0, 1, 3, 2, 2, 0, 0, "제2조의2 삭제"),
        (0, 1, 3, 3, 1, 0, 0, "제3조"),
        (0, 1, 3, 3, 1, 0, 1, "다"),
        (1, 2, 0, 4, 1, 0, 0, "제2편 각칙"),
        (0, 2, 0, 4, 1, 0, 0, "제4조"),
    ]


def test_article_before_any_part_has_part_zero(spark):
    rows = hierarchy.clause_table(statutes(spark, ARTICLES[1:2]), "law_id", "seq").collect()
    assert {(r["part"], r["chapter"]) for r in rows} == {(0, 0)}


def test_query_table(spark):
    clauses = hierarchy.clause_table(statutes(spark), "law_id", "seq")
    rows = hierarchy.query_table(clauses, "형법", "law_id", "seq").orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in rows] == [
        (0, "형법 제1조"),
        (1, "형법 제1조 제1항"),
        (2, "형법 제1조 제1항 제1호"),
        (3, "형법 제1조 제1항 제2호"),
        (4, "형법 제1조 제2항"),
        (5, "형법 제3조"),
        (6, "형법 제3조 제1호"),
        (7, "형법 제4조"),
    ]


@pytest.mark.parametrize("hot_rows", [None, 10, 1])
@pytest.mark.parametrize("step", [1, 1_000_000])
def test_carry_headings_does_not_depend_on_the_ranges(spark, step, hot_rows):
    """One hot group, one small and one of NULL; sequences dense or as sparse as time stamps."""
    sizes = {"a": 60, "b": 5, None: 20}
    rows = [
        (g, s * step, s // 7 if s % 7 == 0 else None, s // 3 if s % 3 == 0 else None) for g, n in sizes.items() for s in range(n)
    ]
    df = spark.createDataFrame(rows, "g string, s long, part int, chapter int")
    kept, outs = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "5", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = ordering.carry_headings(df, "g", "s", content=None, hot_rows=hot_rows).select("g", "s", "part", "chapter")
            outs.append(sorted(map(tuple, found.collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 85
    want, part, chapter = [], {}, {}
    for g, s, p, c in rows:
        part[g] = p if p is not None else part.get(g, 0)
        chapter[g] = c if c is not None else 0 if p is not None else chapter.get(g, 0)
        want.append((g, s, part[g], chapter[g]))
    assert outs[0] == sorted(want, key=repr)
    assert ("a", 8 * step, 1, 0) in outs[0] and ("a", 10 * step, 1, 3) in outs[0]


def test_ids_by_group_follow_the_order(spark):
    rows = [(g, s, p) for g in ("b", "a", None) for s in range(4) for p in range(3)]
    df = spark.createDataFrame(rows, "g string, s long, p int")
    found = ordering.ids_by_group(df.repartition(5), ["g", "s"], ["p"], start=7).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(found, key=lambda r: r["id"])] == want
    assert sorted(r["id"] for r in found) == list(range(7, 43))


def test_dense_ids_keep_the_order_of_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    for n in (1, 3, 16):
        out = ordering.dense_ids(df.repartition(n), "v", start=5).collect()
        assert sorted((r["id"], r["v"]) for r in out) == [(v + 5, v) for v in range(1000)]


def test_head_sample_and_sort(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("id"))
    assert [r["id"] for r in ordering.head_sample(df, "id").collect()] == list(range(16))
    assert [r["id"] for r in ordering.sort_by_id(df).collect()] == list(range(100))
