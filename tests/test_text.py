"""Packed metadata, names and keys."""

from pyspark.sql import functions as F

from affinity.functions import text

PACKED = 'spotify:track:u1\t# Track: "T - Live" by "A"(spotify:artist:ID1), "B"(spotify:artist:ID2), and C(spotify:artist:ID3). {mid}Released on {day}. Descriptors: {tags}.'


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_parse(spark):
    p = one(spark, text.parse_packed, PACKED.format(mid="Producer: P and Q. Writer: X, Y. ", day="2024-01-31", tags='country, "rock and roll", and sad'))
    assert p.track_name == "T - Live"
    assert [(a.name, a.uri) for a in p.artists] == [("A", "ID1"), ("B", "ID2"), ("C", "ID3")]
    assert (p.producers, p.composers) == (["P", "Q"], ["X", "Y"])
    assert (p.release_date, p.descriptors) == ("2024-01-31", ["country", "rock and roll", "sad"])


def test_rows_that_do_not_parse(spark):
    good = PACKED.format(mid="", day="2024-01-31", tags="pop")
    assert one(spark, text.parse_packed, good) is not None
    for bad in [good.replace("\t", " "), good.split(" Descriptors")[0], PACKED.format(mid="", day="unknown", tags="pop"), None, ""]:
        assert one(spark, text.parse_packed, bad) is None


def test_credits(spark):
    got = one(spark, text.artists, "Björk Duo(spotify:artist:X1) and And Bob & Co(spotify:artist:X2)")
    assert [a.uri for a in got] == ["X1", "X2"]
    assert got[0].name == "rk Duo"  # a bare name keeps only its trailing ASCII run
    assert got[1].name == "And Bob & Co" or got[1].name == "Bob & Co"


def test_lists(spark):
    assert one(spark, text.split_quoted, 'X and Y') == ["x", "y"]
    assert one(spark, text.split_quoted, 'country and "country blues"') == ["country", "country blues"]
    assert one(spark, text.split_names, '"A and B", C') == ["A", "B", "C"]
    assert one(spark, text.split_names, None) == []


def test_versions(spark):
    cases = {"Song - Live At X": "Song At X", "Song - Remastered 2011": "Song 2011", "The-lively one": "Thely one", "Song": "Song", "A - feat. B and C": "A"}
    assert {k: one(spark, text.canonical_name, k) for k in cases} == cases
    assert one(spark, lambda c: text.canonical_name(c, True), "Song - Remastered 2011") == "Song"
    kinds = {"Alive": "live", "X - Remaster": "remaster", "X Remix": "remix", "X Radio Edit": "radio_edit", "Acoustic X": "acoustic", "X": "original", "X - Deluxe": "other"}
    assert {k: one(spark, text.version_type, k) for k in kinds} == kinds


def test_years(spark):
    assert one(spark, text.release_year, "1999-01") == 1999
    assert one(spark, text.release_year, "abcd") is None
    assert one(spark, text.decade, 1999, "int") == 1990


def test_classify(spark):
    assert one(spark, text.classify, ["salsa", "pop", "latin", "rap"], "array<string>") == ["latin", "pop", "hip_hop_rap"]
    assert one(spark, text.classify, ["x"], "array<string>") == ["unknown"]
    assert one(spark, text.moods, ["soulful", "x", "sad"], "array<string>") == ["soulful", "sad"]


def test_keys(spark):
    same = [("Lil Wayne", "Lil' Wayne"), ("DON WEST", "Don West"), ("A & B", "A, B"), ("Straße", "STRASSE"), ("ﬁne  x", "fine x"), ("It’s", "Its")]
    for a, b in same:
        assert one(spark, text.loose_key, a) == one(spark, text.loose_key, b)
    assert one(spark, text.punctuation_key, "H.E.R.") == one(spark, text.punctuation_key, "Her")
    assert one(spark, text.loose_key, "H.E.R.") != one(spark, text.loose_key, "Her")
    assert [one(spark, text.is_upper, x) for x in ("ABC", "Abc", "12")] == [True, False, False]


def test_display(spark):
    assert [one(spark, text.duration, s, "long") for s in (150, 210, 3599, 3600, 9000)] == ["2 min", "4 min", "60 min", "1.0 hrs", "2.5 hrs"]
    assert one(spark, text.escaped, "<a & b>") == "&lt;a & b&gt;"
    assert one(spark, text.file_name, 'a/b:c*"d') == "abcd"
    assert one(spark, text.primary_tag, ["USA", "rock"], "array<string>") == "rock"
    assert one(spark, text.primary_tag, ["USA"], "array<string>") == "untagged"
