import time

from hypothesis import given, settings
from hypothesis import strategies as st

from orefield.operators.packed import split_field, split_packed

CASES = {
    "A, B": ["A", "B"],
    "A;B|C||D": ["A", "B", "C", "D"],
    "Tyre/Wheel Repair, Do-It-Yourself Food": ["Tyre/Wheel Repair", "Do-It-Yourself Food"],
    "Food / Bars / Tapas/Small Plates": ["Food", "Bars", "Tapas/Small Plates"],
    "Coffee & Tea\tBars\nFood": ["Coffee & Tea", "Bars", "Food"],
    "Food • Bars": ["Food", "Bars"],
    '"Salads, Cold Plates"; Food': ["Salads, Cold Plates", "Food"],
    '"Rooms ""by the Hour"""|"""Nook"" Cafés"': ['Rooms "by the Hour"', '"Nook" Cafés'],
    '["A", "Rooms \\"by the Hour\\"", "Caf\\u00e9"]': ["A", 'Rooms "by the Hour"', "Café"],
    "['A','Gifts / Souvenirs',\"Children's Wear\"]": ["A", "Gifts / Souvenirs", "Children's Wear"],
    "Children's Wear, Men's Barbers": ["Children's Wear", "Men's Barbers"],
    "“Bars, Wine”, “Delis”": ["Bars, Wine", "Delis"],
    "Bars\\, Wine, Food": ["Bars, Wine", "Food"],
    ", Food , , Bars;; ": ["Food", "Bars"],
    "Bars (Wine, Beer), Food": ["Bars (Wine, Beer)", "Food"],
    "A (B, C": ["A (B", "C"],
    '"unclosed, B': ['"unclosed', "B"],
    "A, A": ["A", "A"],
    '"", A': ["A"],
    "'tis, A": ["'tis", "A"],
    "[a, b": ["[a", "b"],
    "": [],
    " , ;": [],
    "[]": [],
}


def test_cases():
    for text, expected in CASES.items():
        assert split_field(text) == expected, text
    assert split_field(None) == []


WORD = st.text("abZé &-'", min_size=1, max_size=6).map(str.strip).filter(lambda w: w and w[0] not in "'")


@settings(max_examples=200, deadline=None)
@given(st.lists(WORD, max_size=6), st.sampled_from([", ", ";", " | ", "||", "\t", "\n", " / ", " • "]))
def test_plain_values_come_back(words, delimiter):
    assert split_field(delimiter.join(words)) == words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('ab,;"|/ []', min_size=1, max_size=8).map(str.strip).filter(bool), max_size=5))
def test_csv_quoting_comes_back(values):
    packed = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_field(packed) == values


@settings(max_examples=300, deadline=None)
@given(st.text("ab,;\"'\\/[]()| ", max_size=30))
def test_never_fails_nor_invents(text):
    for value in split_field(text):
        assert value and value == value.strip()


def test_hostile_fields_take_linear_time():
    began = time.perf_counter()
    for text in ('"a,' * 60_000 + '\\"', "(a,[b;" * 60_000, "[" * 100_000, "'x''," * 40_000):
        assert all(v == v.strip() and v for v in split_field(text))
    assert time.perf_counter() - began < 20


def test_searches_for_a_closing_quote_share_what_failed():
    assert split_field('"a,"","b') == split_field('"a,"","b') == ['"a', '"b']


def test_rows(spark):
    df = spark.createDataFrame([(1, "A, B", "x"), (2, None, "y"), (3, "", "z"), (4, "A,A", "w"), (5, "x" * 200_000, "v"), (1, "C", "u")], "id long, f string, value string")
    rows = {(r.id, r.pos, r.v) for r in split_packed(df, "f", ["id"], value="v").collect()}
    assert rows == {(1, 1, "A"), (1, 2, "B"), (4, 1, "A"), (4, 2, "A"), (5, 1, "x" * 200_000), (1, 1, "C")}
    assert split_packed(df.limit(0), "f", ["id"]).count() == 0
