"""Mapping freely typed values to a reference list: symmetric-delete lookup with weighted Damerau-Levenshtein ranking.

1. *Forms.* Each distinct value is brought to a few comparable forms: without case, accents, blanks and punctuation; without additions
   such as a code after a comma, a number, words in parentheses or a leading "Greater"; with abbreviations written out; with the parts
   around a comma swapped. Every step away from what was typed costs a little.
2. *Symmetric deletes.* All strings that come from the beginning of a form by deleting up to ``max_edits`` characters are its keys; the
   same keys of the reference names form the dictionary. Two strings within ``max_edits`` edits share a key. The dictionary is broadcast
   if it has at most ``max_broadcast`` rows (counted), and joined by shuffle beyond.
3. *Ranking.* Candidates within ``max_edits`` edits (fewer for short names) are ranked by a weighted Damerau-Levenshtein distance, in
   which look-alikes, doubled letters and swapped neighbours cost less; then by how often the reference name itself occurs in the
   data, then by id. Values without a candidate are reported as unmatched.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.operators.hotkeys import bounded_broadcast, hot_split_join
from orefield.session import cut_lineage, default_parallelism

#: Common abbreviations in place names.
ABBREVIATIONS = {
    "st": "saint", "ste": "saint", "snt": "saint", "pt": "port", "prt": "port", "ft": "fort", "frt": "fort", "mt": "mount", "mnt": "mount", "mtn": "mountain", "lk": "lake",
    "n": "north", "no": "north", "s": "south", "so": "south", "e": "east", "w": "west", "nth": "north", "hts": "heights", "hgts": "heights", "ht": "heights", "spgs": "springs", "spg": "springs",
    "sprgs": "springs", "spngs": "springs", "fls": "falls", "fl": "falls", "pk": "park", "prk": "park", "lndg": "landing", "ldg": "landing", "lnd": "landing", "jct": "junction", "jctn": "junction", "junct": "junction",
    "jnctn": "junction", "bch": "beach", "hbr": "harbor", "harb": "harbor", "hrbr": "harbor", "brg": "bridge", "brdg": "bridge", "bdg": "bridge", "grn": "green", "xing": "cross", "crs": "cross", "crss": "cross",
    "rdg": "ridge", "rdge": "ridge", "flts": "flats", "flt": "flats", "hl": "hill", "hll": "hill", "cstl": "castle", "cas": "castle", "ctl": "castle", "pnt": "point", "pts": "point", "by": "bay",
}
#: Words that qualify a place without naming another one.
PREFIXES = ("city of", "town of", "village of", "downtown", "uptown", "greater", "metro", "near", "the", "old", "central", "north of", "outside")
_LOOKALIKE = str.maketrans("013457$@", "oieastsa")
_SIMILAR = {frozenset(p) for p in ("0o", "1i", "1l", "il", "3e", "5s", "4a", "7t", "uv", "vw", "sz", "ck", "iy", "mn", "ae", "ei", "ou")}


#: Additions that are left out: parentheses, a number at the end, what follows a dash or slash, two letters at the end.
_ADDITIONS = (r"\([^)]*\)?", r"\b\d{4,}(?:-\d+)?\b\s*$", r"\s+[-/]\s+\S.*$", r"(?:\s*,\s*|\s+)[a-z]{2}\.?\s*$")


@dataclass(frozen=True)
class FormRules:
    """What counts as an addition, and what it costs to leave it out."""

    abbreviations: dict[str, str] = field(default_factory=lambda: dict(ABBREVIATIONS))
    prefixes: tuple[str, ...] = PREFIXES
    step: float = 0.05
    swaps: int = 2


def plain(text: str) -> str:
    """Lower case, without accents; separators as blanks."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^\w,()/\-.&' ]|_", " ", text.replace("\t", " "))).strip()


def squeeze(text: str) -> str:
    return re.sub(r"[\W_]+", "", text)


def forms(text: str | None, rules: FormRules = FormRules()) -> dict[str, float]:
    """Comparable forms of a typed value with their costs.

    Shortening and writing out abbreviations go on until nothing new comes, however many additions there are. The parts at a comma are
    swapped at most ``rules.swaps`` times on the way to a form, since arrangements of parts without a limit grow exponentially.
    """
    if text is None:
        return {}
    start = plain(text)
    todo: dict[str, float] = {start: 0.0}
    for wrong in ("cp1252", "latin-1"):  # UTF-8 that was read in a one-byte encoding
        try:
            todo.setdefault(plain(text.encode(wrong).decode("utf-8")), rules.step)
        except UnicodeError:
            pass
    queue = deque((form, 0) for form in todo)
    fewest = dict.fromkeys(todo, 0)  # swaps on the way to each form
    while queue:
        now, swaps = queue.popleft()
        cost = todo[now] + rules.step
        steps = {(re.sub(pattern, " ", now), swaps) for pattern in _ADDITIONS}
        if "," in now:
            head, _, tail = now.partition(",")
            steps.add((head, swaps))
            if tail.strip() and swaps < rules.swaps:
                steps.add((f"{tail} {head}", swaps + 1))
        for prefix in rules.prefixes:
            if now.startswith(prefix + " "):
                steps.add((now[len(prefix) + 1 :], swaps))
        words = re.split(r"[\s./\-]+", now)
        written = [rules.abbreviations.get(w.strip(",'"), w) for w in words]
        if written != words:
            steps.add((" ".join(written), swaps))
        for step, swapped in steps:
            step = re.sub(r"\s+", " ", step).strip(" ,./-'")
            if step and swapped < fewest.get(step, math.inf):
                todo[step] = min(cost, todo.get(step, math.inf))
                fewest[step] = swapped
                queue.append((step, swapped))
    out: dict[str, float] = {}
    for form, cost in todo.items():
        bare = squeeze(form)
        readings = [bare]
        if any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare):
            readings.append(bare.translate(_LOOKALIKE))
        for reading in readings:
            if reading and cost < out.get(reading, math.inf):
                out[reading] = cost
    return out


def delete_keys(text: str, max_edits: int, prefix: int = 8) -> set[str]:
    """All strings that come from the first ``prefix`` characters by deleting up to ``max_edits`` of them."""
    head = text[:prefix]
    return {"".join(c for k, c in enumerate(head) if k not in gone) for d in range(min(max_edits, len(head)) + 1) for gone in combinations(range(len(head)), d)}


def edit_distances(a: str, b: str, limit: int) -> tuple[int, float] | None:
    """Plain and weighted Damerau-Levenshtein distance; None if the plain one is above ``limit``.

    Swapped neighbours may have other characters inserted or deleted between them, as in the unrestricted distance.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    far = (limit + 1, 99.0)
    table = [[(max(i, j), float(max(i, j))) if not i or not j else far for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    last_row: dict[str, int] = {}  # the last row of each character of a
    for i in range(1, len(a) + 1):
        x, last_column = a[i - 1], 0
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            y = b[j - 1]
            same = x == y
            swap_cost = 0.5 if frozenset((x, y)) in _SIMILAR else 1.0
            gone = 0.6 if i > 1 and a[i - 2] == x else 1.0
            more = 0.6 if j > 1 and b[j - 2] == y else 1.0
            (dn, dw), (un, uw), (ln, lw) = table[i - 1][j - 1], table[i - 1][j], table[i][j - 1]
            n = min(dn + (not same), un + 1, ln + 1)
            w = min(dw + (0.0 if same else swap_cost), uw + gone, lw + more)
            k, m = last_row.get(y, 0), last_column
            if k and m:
                between = (i - k - 1) + (j - m - 1)
                pn, pw = table[k - 1][m - 1]
                n, w = min(n, pn + between + 1), min(w, pw + between + 0.7)
            if same:
                last_column = j
            table[i][j] = (n, w)
        last_row[x] = i
    n, w = table[-1][-1]
    return (n, w) if n <= limit else None


def allowed_edits(length: int, max_edits: int) -> int:
    """Edits allowed for a name of this length: none up to 2 letters, one up to 5, then ``max_edits``."""
    return 0 if length <= 2 else min(max_edits, 1) if length <= 5 else max_edits


def match_values(values: DataFrame, value: str, reference: DataFrame, ref_id: str, ref_name: str, aliases: list[str] = (), max_edits: int = 2, rules: FormRules = FormRules(), max_broadcast: int = 300_000) -> DataFrame:
    """One row per distinct non-null value: (value, n, ref_id, distance); ref_id is null if the value means no entry.

    ``reference`` has an integer id, a name and maybe alias columns (null where there is none); entries with a null name or id are
    skipped. ``distance`` is the weighted distance plus the cost of the form. Values that are blank have no form and no match. Ties go
    to the entry that is typed right more often, then to the smaller id.
    """

    @F.pandas_udf("array<struct<form: string, cost: double, keys: array<string>>>")
    def keyed_forms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(f, c, sorted(delete_keys(f, allowed_edits(len(f), max_edits)))) for f, c in forms(t, rules).items()])

    @F.pandas_udf("array<string>")
    def reference_keys(names: pd.Series) -> pd.Series:
        return names.map(lambda t: sorted(delete_keys(t, max_edits)))

    @F.pandas_udf("string")
    def reference_form(names: pd.Series) -> pd.Series:
        return names.map(lambda t: squeeze(plain(t)))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # an iterator, not a function of columns: the filter on the distance would have the optimiser evaluate that several times
        for frame in frames:
            found = [edit_distances(a, b, allowed_edits(min(len(a), len(b)), max_edits)) for a, b in zip(frame["form"], frame["name_form"])]
            keep = [f is not None for f in found]
            out = frame.loc[keep, ["value", "ref_id", "freq"]]
            yield out.assign(score=[round(f[1] + c, 6) for f, c, k in zip(found, frame["cost"], keep) if k])

    distinct = cut_lineage(values.select(F.col(value).cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    names = F.array(*[F.col(c).cast("string") for c in [ref_name, *aliases]])
    listed = reference.where(F.col(ref_id).isNotNull()).select(F.col(ref_id).alias("ref_id"), F.col(ref_name).cast("string").alias("ref_name"), F.explode(names).alias("name")).where("name IS NOT NULL AND trim(name) <> ''")
    typed_right = distinct.select(F.col("value").alias("ref_name"), F.col("n").alias("freq"))
    freqs = typed_right.join(bounded_broadcast(listed.select("ref_name").distinct(), max_broadcast), "ref_name", "left_semi")  # no more rows than names
    entries = listed.join(bounded_broadcast(freqs, max_broadcast), "ref_name", "left").select("ref_id", F.coalesce("freq", F.lit(0)).alias("freq"), reference_form("name").alias("name_form"))
    dictionary = entries.where("name_form <> ''").select("ref_id", "freq", "name_form", F.explode(reference_keys("name_form")).alias("key"))
    dictionary = cut_lineage(dictionary)

    # few bytes, much work per value: spread over all cores, not by file size
    spread = distinct.repartition(default_parallelism(distinct.sparkSession), "value")
    looked_up = spread.select("value", F.explode(keyed_forms("value")).alias("f")).select("value", "f.form", "f.cost", F.explode("f.keys").alias("key"))
    candidates = looked_up.join(bounded_broadcast(dictionary, max_broadcast), "key").select("value", "form", "cost", "ref_id", "freq", "name_form").distinct()
    kind = dictionary.schema["ref_id"].dataType.simpleString()
    near = candidates.mapInPandas(scored, f"value string, ref_id {kind}, freq long, score double")
    best = near.groupBy("value").agg(F.min(F.struct("score", (-F.col("freq")).alias("freq"), "ref_id")).alias("best")).select("value", F.col("best.ref_id").alias("ref_id"), F.col("best.score").alias("distance"))
    return distinct.join(best, "value", "left").select("value", "n", "ref_id", "distance")


def map_rows(rows: DataFrame, value: str, matches: DataFrame, keep: list[str]) -> DataFrame:
    """The rows with a non-null value, with ``keep``, and the ref_id of their value; a value that a large part of the rows share is no hot spot."""
    matches = cut_lineage(matches)
    left = rows.select(*keep, F.col(value).cast("string").alias("value")).where("value IS NOT NULL")
    return hot_split_join(left, matches.select("value", "ref_id"), "value").select(*keep, "value", "ref_id")
