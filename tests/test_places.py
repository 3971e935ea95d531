"""Place search against brute force."""

import pytest

from kerbline.functions import text as tx
from kerbline.operators import places

PLACES = [
    (1, "place", "Student Life Centre", "building", "student life centre", ["SLC"], ["slc"]), (2, "place", "Engineering 5", "building", "engineering 5", ["E5"], ["e5"]),
    (3, "place", "University Club", "restaurant", "university club", [], ["uc"]), (4, "place", "Slate Cafe", "cafe", "slate cafe", None, ["sc"]),
    (5, "address", "12 King Street", "address", "12 king street", [], []), (6, "address", "125 King Street", "address", "125 king street", [], []),
    (7, "place", "Unit", "shop", "unit", ["UC"], None), (8, "place", "E 55", "shop", "east 55", ["E55"], []), (9, "street", "King Street", None, "king street", ["K"], []),
    (10, "place", "Stone Hall", "building", "stone hall", ["ST1"], ["sh"]), (11, "place", "Student Life Centre", "taxi", "student life centre", [], []),
    (12, "place", "Student Life Centre", "transit stop", "student life centre", [], []), (13, "place", "Student Life Centre Annex", "transit stop", "student life centre annex", [], []),
    (14, "place", "University of Waterloo Student Life Centre", "building", "university of waterloo student life centre", [], []),
]
SCHEMA = "place_id int, kind string, label string, category string, search_text string, codes array<string>, initialisms array<string>"
TEXTS = ["sl", "slc", "e 5", "e5", "e", "u c", "uc", "12 king", "k", "king 12", "student life", "student life centre", "student student life", "street", "s", "cafe sl", "125", "5 e", "zzz", ""]


def brute(text):
    terms = list(dict.fromkeys(text.split()))
    small = text.replace(" ", "")
    for i, _, _, _, content, codes, initials in PLACES:
        codes, words = [c.lower() for c in codes or []], content.split()
        fits = all(any(w == t if t.isdigit() else w.startswith(t) for w in words) for t in terms)
        if terms and (fits or small in codes or small in (initials or []) or len(small) >= 2 and any(c.startswith(small) for c in codes)):
            yield i


def test_exact_same_as_brute_force(spark):
    asked = spark.createDataFrame(list(enumerate(TEXTS)), "query_id int, text string")
    got = [(r.query_id, r.place_id) for r in places.exact_hits(asked, spark.createDataFrame(PLACES, SCHEMA)).collect()]
    assert sorted(got) == sorted((q, p) for q, t in enumerate(TEXTS) for p in brute(t))


def test_code_as_typed(spark):
    asked = spark.createDataFrame([(1, "street 1", "st1"), (2, "street 1", None)], "query_id int, text string, code string")
    assert [(r.query_id, r.place_id, r.tier) for r in places.exact_hits(asked, spark.createDataFrame(PLACES, SCHEMA)).collect()] == [(1, 10, 0)]


def sorted_similarity(first, second):
    def pieces(t):
        return [f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)]

    a, b = set(pieces(first)), pieces(second)
    return max((len(a & (e := set(b[i:j]))) / len(a | e) for i in range(len(b)) for j in range(i + 1, len(b) + 1)), default=0.0)


def test_word_similarity(spark):
    pairs = [("word", "two words"), ("waterlo", "university of waterloo student life centre"), ("abc", "xyz"), ("aa aa", "aaaa aa"), ("konestoga mall", "conestoga mall"), ("a", "")]
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("s", tx.word_similarity("a", "b")).collect()
    assert got[0].s == pytest.approx(0.8)  # the example in pg_trgm's manual
    assert [r.s for r in got] == pytest.approx([sorted_similarity(*p) for p in pairs])


def test_fuzzy_same_as_brute_force(spark):
    texts = ["waaterloo", "stident life", "enginering", "kingg", "slte cafe", "qqq"]
    got = places.search(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), spark.createDataFrame(PLACES, SCHEMA), limit=20).collect()
    wanted = {(q, p[0], round(s, 6)) for q, t in enumerate(texts) for p in PLACES if (s := sorted_similarity(t, p[4])) >= 0.6}
    assert {(r.query_id, r.place_id, r.similarity) for r in got} == wanted
    assert (0, 14) in {w[:2] for w in wanted}


def test_places_before_stops_and_incidentals(spark):
    asked = spark.createDataFrame([(1, "student life centre"), (2, "student life")], "query_id int, text string")
    got = places.search(asked, spark.createDataFrame(PLACES, SCHEMA)).orderBy("query_id", "rank").collect()
    assert [(r.place_id, r.tier) for r in got if r.query_id == 1] == [(1, 1), (12, 5), (13, 6), (14, 7), (11, 7)]
    assert [(r.place_id, r.tier) for r in got if r.query_id == 2] == [(1, 4), (12, 6), (13, 6), (14, 7), (11, 7)]
