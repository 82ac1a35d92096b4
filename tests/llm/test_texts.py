import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import SparkFiles
from pyspark.sql import functions as F

from orefield.llm.canonical import delete_keys, edit_distances, forms, map_rows, match_values
from orefield.llm.mixing import filled, mix, reached_shares
from orefield.llm.packing import pack, pack_local, place_items, sweep
from orefield.llm.queries import LLM
from orefield.llm.residue import PATTERNS, clean_documents, evidence_of, residue_documents
from orefield.llm.tokens import encoder, VOCABULARY, token_count


def brute_distance(a, b):
    last, table = {}, {(-1, -1): len(a) + len(b)}
    big = len(a) + len(b)
    for i in range(len(a) + 1):
        table[i, -1], table[i, 0] = big, i
    for j in range(len(b) + 1):
        table[-1, j], table[0, j] = big, j
    for i in range(1, len(a) + 1):
        m = 0
        for j in range(1, len(b) + 1):
            k, l = last.get(b[j - 1], 0), m
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, m = 0, j
            table[i, j] = min(table[i - 1, j - 1] + cost, table[i, j - 1] + 1, table[i - 1, j] + 1, table[k - 1, l - 1] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
    return table[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_distance_and_keys(a, b):
    d = brute_distance(a, b)
    found = edit_distances(a, b, 2)
    assert (found is None) == (d > 2)
    if found:
        assert found[0] == d and found[1] <= d + 1e-9
        assert delete_keys(a, 2) & delete_keys(b, 2)


def test_matching(spark):
    ref = spark.createDataFrame([(1, "Saint Orlo", None), (2, "Port Hallow", "Hallow Roads"), (3, "São Lúvio", None), (None, "Nowhere", None), (4, None, None)], "id int, name string, alias string")
    means = {"Saint Orlo": 1, "ST. ORLO": 1, "Orlo, Saint": 1, "Saitn Orlo": 1, "Saint-Orlo, QA 12345": 1, "City of Saint Orlo": 1, "Port Hallow (Airport)": 2, "The Hallow Roads": 2, "Sao Luvio": 3, "SÃ£o LÃºvio": 3, "Sa1nt Orl0": 1}
    none = ["Downtown", "???", "", "  ", "Port Sellamy", "Saint Veddic", "x" * 5000, "N/A"]
    rows = [(k, v) for k, v in enumerate([*means, *none, None, *["Saint Orlo"] * 50])]
    df = spark.createDataFrame(rows, "rid long, city string")
    matches = match_values(df, "city", ref, "id", "name", ["alias"])
    got = {r.value: r.ref_id for r in matches.collect()}
    assert got == means | dict.fromkeys(none)
    mapped = {(r.rid, r.ref_id) for r in map_rows(df, "city", matches, ["rid"]).collect()}
    assert len(mapped) == len(rows) - 1 and (0, 1) in mapped
    wide = match_values(df, "city", ref, "id", "name", ["alias"], max_broadcast=0)
    assert {r.value: r.ref_id for r in wide.collect()} == got
    assert match_values(df.limit(0), "city", ref, "id", "name").count() == 0
    assert forms(None) == {} and forms(" ,") == {}


def test_many_additions_at_once():
    additions = "near the old city of Orlo, Greater Saint - x, ab cd ef gh ij kl mn, op, qr, st 12345"
    codes = "City of the old central St. Orlo, qa, us, na, eu, wd, xx, yy, zz, ab, cd, ef, gh"
    assert "saintorlo" in forms(codes) and "orlo" in forms(additions)
    assert len(forms(", ".join(["ab", "cd"] * 30))) < 20_000


def brute_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fitting = [g for g in gaps if g >= s]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_rounds_pack_like_best_fit(sizes):
    place = pack_local(np.array(sizes, dtype=np.int64), 30)
    load = Counter()
    for where, n in zip(place.tolist(), sizes):
        load[where] += n
    assert len(place) == len(sizes) and -1 not in load and all(v <= 30 for v in load.values())
    used = len(load)
    assert used <= brute_best_fit(sizes, 30) + max(1, used // 20)


def brute_sweep(is_gap):
    stack, pairs, gaps = [], set(), []
    for k, g in enumerate(is_gap):
        if not g:
            stack.append(k)
        elif stack:
            pairs.add((stack.pop(), k))
        else:
            gaps.append(k)
    return pairs, stack[::-1], gaps


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=40))
def test_sweep(is_gap):
    items, gaps, free_items, free_gaps = sweep(np.array(is_gap, dtype=bool))
    assert (set(zip(items.tolist(), gaps.tolist())), free_items.tolist(), free_gaps.tolist()) == brute_sweep(is_gap)


@pytest.mark.parametrize("ranges", [1, 3, 11])
def test_rounds_are_the_same_for_any_number_of_ranges(spark, ranges):
    rng = random.Random(8)
    sizes = [rng.choice([rng.randint(1, 64), rng.randint(1, 9), 7, 33]) for _ in range(700)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long").repartition(4)
    got = {r.item: r.container for r in place_items(items, 64, local_items=0, ranges=ranges).collect()}
    assert [got[k] for k in range(700)] == pack_local(np.array(sizes, dtype=np.int64), 64).tolist()
    assert {r.item: r.container for r in place_items(items, 64).collect()} == got


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 7, 40, 60, 99, 100, 100, 101, 250])) for i in range(500)] + [(501, None), (7, 40), (None, 5)]
    df = spark.createDataFrame(rows, "d long, part int").repartition(4)
    got = pack(df, "d", "part", 100).collect()
    load, parts = defaultdict(list), defaultdict(list)
    for r in got:
        if r.container_id is not None:
            load[r.container_id].append((r.at, r.n_tokens))
            parts[r.item_id].append((r.start, r.n_tokens))
    for held in load.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 100
    total = Counter()
    for d, n in rows:
        total[d] += n or 0
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == {d: n for d, n in total.items() if n}
    assert sum(1 for r in got if r.container_id is None) == sum(1 for _, n in rows if not n)
    assert all(len(p) == 1 or d == 7 for d, p in parts.items() if total[d] <= 100)
    assert sum(total.values()) / (100 * len(load)) > 0.95
    assert pack(df.limit(0), "d", "part", 100).count() == 0


def brute_fill(budget, children):
    """[(weight, capacity)] filled round by round."""
    given = [0.0] * len(children)
    left = min(budget, sum(c for w, c in children if w))
    active = [k for k, (w, c) in enumerate(children) if w and c]
    while active and left > 1e-9:
        weights = sum(children[k][0] for k in active)
        full = [k for k in active if given[k] + left * children[k][0] / weights >= children[k][1]]
        if not full:
            for k in active:
                given[k] += left * children[k][0] / weights
            break
        for k in full:
            left -= children[k][1] - given[k]
            given[k] = float(children[k][1])
            active.remove(k)
    return given


def test_vessels_fill_to_one_level(spark):
    rng = random.Random(5)
    nodes = {f"p{p}": (rng.randint(0, 300), [(rng.choice([1.0, 0.5, rng.random()]), rng.randint(1, 90)) for _ in range(rng.randint(1, 7))]) for p in range(40)}
    rows = [(p, f"{p}-{k}", w, float(c), float(b)) for p, (b, kids) in nodes.items() for k, (w, c) in enumerate(kids)]
    got = {r.node: r.budget for r in filled(spark.createDataFrame(rows, "parent string, node string, weight double, capacity double, budget double")).collect()}
    for p, (b, kids) in nodes.items():
        for k, want in enumerate(brute_fill(b, kids)):
            assert abs(got[f"{p}-{k}"] - want) < 1e-6


def test_siblings_fill_before_ancestors(spark):
    sizes = {("books", "a", "en"): 100, ("books", "b", "en"): 4000, ("web", "c", "en"): 4000, ("web", "c", "de"): 50, ("web", "d", "fr"): 3000}
    rows = [(k, *path, 10) for k, path in enumerate(path for path, size in sizes.items() for _ in range(size // 10))]
    df = spark.createDataFrame(rows, "id long, domain string, source string, lang string, n long")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.2, 1), ("c", 0.4, 1), ("d", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = Counter()
    for r in mix(df, "id", "n", ["domain", "source", "lang"], targets, total=2000, level="source", weights={"lang": {"en": 1.0, "de": 3.0, "fr": 1.0}}).collect():
        got[r.domain, r.source, r.lang] += r.used_tokens
    # a can give 200 of its 600: the 400 go to b, not to the web; de can give 50 of its 600: the rest goes to en
    assert got == {("books", "a", "en"): 200, ("books", "b", "en"): 800, ("web", "c", "en"): 750, ("web", "c", "de"): 50, ("web", "d", "fr"): 200}
    more = Counter()
    for r in mix(df, "id", "n", ["domain", "source", "lang"], targets, total=10_000, level="source").collect():
        more[r.domain] += r.used_tokens
    assert more == {"books": 4200, "web": 5800}  # books are used up, and what they lack goes to the web


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["small"]), rng.choice(["en", "de", None]), rng.randint(1, 50)) for i in range(1500)]
    rows += [(9000, "other", "en", 10), (9001, None, "en", 10), (9002, "big", "en", None), (9003, "big", "en", 0)]
    df = spark.createDataFrame(rows, "id long, source string, lang string, n long").repartition(5)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.25, 3), ("none", 0.05, 1)], "source string, target_share double, max_repeats int")
    selected = mix(df, "id", "n", ["source", "lang"], targets, seed=1).cache()
    shares = {r.source: r for r in reached_shares(selected, "source", targets).collect()}
    for name, want in (("big", 0.5 / 0.95), ("mid", 0.2 / 0.95), ("small", 0.25 / 0.95), ("none", 0.0)):
        assert abs(shares[name].reached_share - want) < 1e-3
        assert shares[name].most_uses <= shares[name].max_repeats
    assert {r.source for r in selected.select("source").distinct().collect()} == {"big", "mid", "small"}
    again = mix(df.repartition(2), "id", "n", ["source", "lang"], targets, seed=1)
    assert sorted(map(str, selected.collect())) == sorted(map(str, again.collect()))
    full = mix(df, "id", "n", ["source", "lang"], targets, total=2 * sum(r[3] or 0 for r in rows), seed=1)
    reached = {r.source: r for r in reached_shares(full, "source", targets).collect()}
    small = sum(r[3] for r in rows if r[1] == "small")
    assert reached["small"].tokens == 3 * small
    assert reached["big"].tokens == sum(r[3] or 0 for r in rows if r[1] == "big")
    assert mix(df.limit(0), "id", "n", ["source"], targets).count() == 0
    selected.unpersist()


FOUND = ["Dear {{ customer }}, thank you.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.", "HTTP 502 Bad Gateway", "Your text here.", "Rated undefined by NULL guests.", "Acceso denegado.", "Checking your browser before you proceed.", "blah blah blah blah", "We are open from [OPENING HOURS] to _____.", "Error 404 (Not Found)"]
TOLD = [
    'The chalk board still says "lorem ipsum" under the soups.',
    "Their booking page threw a 500 error twice.",
    "The owner used to write JavaScript for a living.",
    'Ask for the "page not found" cocktail.',
    "We had drinks at the TBD Taproom next door.",
    "Their form wants [first name] in capitals.",
    "The fee is null and void once the pie arrives.",
    "Cookies are required at any good café [and here they are great].",
    "It was [really] great, 10% cheaper.",
]


def test_evidence():
    assert all(evidence_of(line) for line in FOUND)
    assert not any(evidence_of(line) for line in TOLD)
    assert evidence_of(None) is None and evidence_of("") is None
    import regex

    for listed in PATTERNS.values():
        for words, pattern in listed:
            regex.compile(pattern)
            assert all(words.split(";"))


def test_prose_with_the_words_of_notices_is_none():
    prose = ["Everybody goes here on Sundays.", "Your team here is great.", "Use code 500 for a discount.", "Area code 415 is ours.", "See the note [*prices may vary].", "Follow us [@home] today.", "They ran out of copy paper, text me.", "More bread, more soup, more wine, more more."]
    assert not [line for line in prose if evidence_of(line)]
    assert all(map(evidence_of, ["Text goes here", "Your text here.", "Image title goes here.", "Error code 503", "Your company name here", "[%name%] is away"]))


def test_residue_documents(spark):
    banner = "This site requires cookies and scripts to work."
    rows = [(k, f"{TOLD[k % len(TOLD)]}\n{banner}", "h1", "a") for k in range(60)]
    rows += [(100 + k, f"Real text first.\n{line}\r\nmore", "h1", "a") for k, line in enumerate(FOUND)]
    rows += [(200, banner, "h2", "a"), (201, None, "h1", "a"), (202, "", None, "a"), (203, " ".join(f"word{k}" for k in range(40_000)), None, "a"), (204, FOUND[0], None, "a"), (205, FOUND[0], None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, line string")
    got = {r.doc_id for r in residue_documents(df, "doc_id", "text", "host").collect()}
    assert got == {*range(100, 100 + len(FOUND)), 200, 204, 205}
    shuffled = {r.doc_id for r in residue_documents(df, "doc_id", "text", "host", max_broadcast=0).collect()}
    assert shuffled == got
    kept = clean_documents(df, "doc_id", "text", "host")
    assert kept.columns == df.columns and kept.count() == len(rows) - len(got)
    assert residue_documents(df.limit(0), "doc_id", "text", "host").count() == 0


def test_long_placeholders_and_lines(spark, tmp_path):
    long = "an expression of more than sixty characters that nobody ever filled in " * 2
    names = "a_name_of_more_than_forty_letters_that_nobody_ever_filled_in"
    marks = [f"{{{{ {long}}}}}", f"${{{long}}}", f"<% {long}%>", f"{{% {long}%}}", f"<<{long}>>", f"[[{long}]]", f"[insert {long}]"]
    marks += [f"__{names}__", f"##{names}##", f"@@{names}@@", f"*|{names}|*", f"%{names}%", f"%({names})s"]
    assert all(evidence_of(mark) == "placeholder" for mark in marks)
    text = "word " * 100 + FOUND[0]
    spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.line for r in LLM.queries["p10_evidence"](spark, str(tmp_path)).collect()] == [text]


def test_copies_are_no_boilerplate(spark):
    page = "HTTP 502 Bad Gateway\n-----\nThe server did not answer, request {}."
    mail = "Dear {{ customer }}, thank you.\nWe look forward to your visit."
    copies = [(k, page.format(k), "h1") for k in range(100)] + [(100 + k, mail, "h2") for k in range(30)]
    copies += [(200 + k, f"{FOUND[0]}\n{FOUND[k % 2]}", "h3") for k in range(40)]
    real = [(1000 + k, f"A good soup {chr(97 + k % 26)}{chr(97 + k // 26)}.", "h1") for k in range(200)] + [(2000, "Nice.", "h2"), (2001, "Fine.", "h2")]
    df = spark.createDataFrame(copies + real, "doc_id long, text string, host string")
    for options in ({}, {"max_broadcast": 0}):
        got = {r.doc_id for r in residue_documents(df, "doc_id", "text", "host", **options).collect()}
        assert got == {r[0] for r in copies}
    assert clean_documents(df, "doc_id", "text", "host").count() == len(real)


def held_out(kind, rng, k):
    """Residue whose names, words and syntaxes no list of the library has."""
    name = rng.choice(["warehouse_bin", "Pet Name", "seatRow", "policy-id", "tariff", "courier", "Vessel.Flag"])
    vocabulary = [f"{a}{b}um" for a in ("vex", "grol", "mir", "tand", "pliv") for b in ("ar", "es", "in", "o")]
    code = rng.choice([411, 418, 431, 451, 507, 511])
    return {
        "strong mark": lambda: rng.choice(["Your {{%s}} is ready.", "Signed, ${%s}.", "About {!%s}: we started small.", "Rated ##%s## by all.", "Hello {{ %s }}!", "On <%%= %s %%> we are closed.", "Meet *|%s|* today.", "The {%% %s %%} is open."]) % name,
        "weak mark": lambda: rng.choice(["Your [%s] is ready.", "Signed, <%s>.", "About {%s}: we started small.", "Rated |%s| by all."]) % name,
        "filler": lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 14))).capitalize() + ".",
        "taught filler": lambda: "Lorem ipsum " + " ".join(rng.choice(vocabulary) for _ in range(12)) + ".",
        "repetition": lambda: rng.choice(["tbc tbc tbc tbc tbc", "Zonk zonk zonk zonk.", "none else none none else none none", "leer leer leer leer"]),
        "status": lambda: rng.choice(["HTTP/2 %d", "Error %d", "status: %d", "Fehler %d.", "http %d"]) % code,
        "exception": lambda: rng.choice(["WidgetOverflowError: row 7", "ParseException: end of file", "quotaerror: none left"]),
        "script": lambda: rng.choice(["Kindly allow the site scripts.", "This corner requires client cookies.", "Switch on your JavaScript first.", "JS is turned off here.", "Cookies are blocked at present."]),
    }[kind]()


def test_recall_on_what_no_list_names(spark):
    rng = random.Random(11)
    kinds = ["strong mark", "weak mark", "filler", "taught filler", "repetition", "status", "exception", "script"]
    prose = ["The soup was warm and the staff was kind on day {}.", "We came {} times and it was great [really].", "They had {} tables, and one was free."]
    rows = [(k, kind, f"{prose[k % 3].format(k)}\n{held_out(kind, rng, k)}", f"h{k % 4}") for k, kind in enumerate(kinds * 30)]
    rows += [(1000 + k, None, f"{prose[k % 3].format(k)}\nWe liked it, {k} of us.", f"h{k % 4}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string, host string").repartition(5)
    got = {r.doc_id for r in residue_documents(df, "doc_id", "text", "host").collect()}
    recall = {kind: sum(r[0] in got for r in rows if r[1] == kind) / 30 for kind in kinds}
    assert min(recall.values()) >= 0.9, recall
    assert not any(r[0] in got for r in rows if r[1] is None)


def test_names_and_words_are_learned_from_the_corpus(spark):
    weak = [(1, "We open on [tariff zone] at noon.", "a"), (2, "Nice soup [really].", "a"), (3, "Brimel tork vasun drell moxit.", "a"), (4, "Good bread, warm welcome, kind staff here.", "a")]
    taught = [(10, "Pay {{ tariff_zone }} now.", "b"), (11, "Lorem ipsum brimel tork vasun drell moxit plun.", "b"), (12, "Your ##Tariff Zone## again.", "c"), (13, "Ipsum vasun lorem tork drell brimel moxit.", "c")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, host string")
    found = lambda rows: {r.doc_id for r in residue_documents(frame(rows), "doc_id", "text", "host").collect()}
    assert found(weak) == set()
    assert found(weak + taught) == {1, 3, 10, 11, 12, 13}
    assert found(weak + taught[:1] * 5 + taught[1:2]) == {10, 11}  # copies teach once


def test_subtraction_decides(spark):
    banner = "Please enable JavaScript to book a table."
    rows = [(k, f"Dish {chr(97 + k)} was good.\n{banner}", "site") for k in range(20)]
    rows += [(100, banner, "site"), (101, f"A fine place.\n{banner}", "elsewhere"), (102, "A fine place.", "elsewhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = {share: {r.doc_id for r in residue_documents(df, "doc_id", "text", "host", boilerplate_share=share).collect()} for share in (0.2, 1.0)}
    assert got[0.2] == {100, 101} and got[1.0] == {*range(20), 100, 101}


def test_vocabulary_comes_with_the_job(spark, tmp_path):
    path = tmp_path / "small.tiktoken"
    path.write_bytes(Path(VOCABULARY).read_bytes())
    counted = spark.createDataFrame([("Hello world",)], "t string").select(token_count(F.col("t"), str(path)).alias("n"))
    assert counted.first().n == len(encoder(VOCABULARY).encode_ordinary("Hello world"))
    assert Path(SparkFiles.get(path.name)).read_bytes() == path.read_bytes()


def test_tokens(spark):
    texts = ["Hello  world", "", None, "Größe 😀\n\n x" * 50]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n")).collect()]
    encode = encoder(VOCABULARY).encode_ordinary
    assert got == [len(encode(t)) if t else 0 for t in texts]
    assert encoder(VOCABULARY).decode(encode(texts[3])) == texts[3]
