"""Schemas that drift from file to file: find each change, match renames, and
read everything into one table.

Every field of every file gets a fixed-size profile (counts by JSON type, class
of its values, level of its numbers, MinHash of its values). Fields that vanish
between a file and the next of its line are matched with those that appear, as
an assignment in the bipartite graph of name and value similarity; what is
matched well enough is a rename. Words that matches exchange over and over, in
several lines, count as the same word in a second matching.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import parse_json
from tidemark.session import materialise

#: MinHash functions for the set of a field's values.
HASHES = 16
#: Fields whose names have nothing in common are one quantity only if at least
#: this share of their MinHashes agrees.
SHARED = 0.5
TYPES = ("number", "string", "boolean", "object", "array")


@lru_cache(maxsize=100_000)
def words(name: str) -> tuple[str, ...]:
    """The words of a field name, whatever its spelling: fooBar, FOO-BAR, foo_bar."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return tuple(w.lower() for w in re.split(r"[^A-Za-z0-9]+", parts) if w)


def rest_words(a: str, b: str) -> tuple[list[str], list[str]]:
    """The words of either name that the other lacks."""
    wa, wb = set(words(a)), set(words(b))
    return sorted(wa - wb), sorted(wb - wa)


def name_similarity(a: str, b: str, synonyms: frozenset = frozenset()) -> float:
    """0 to 1: shared words, shortened words, and words that stand for each other
    in synonyms, a set of sorted pairs."""
    wa, wb = words(a), words(b)
    if not wa or not wb:
        return float(a == b)
    if sorted(wa) == sorted(wb):
        return 1.0
    ca, cb = set(wa), set(wb)
    same = ca & cb
    rest_a, rest_b = sorted(ca - same), sorted(cb - same)
    near = 0.0
    for x in rest_a:  # a short form keeps the first letter, and the others in order
        for y in rest_b:
            if (min(x, y), max(x, y)) in synonyms:
                near += 1.0
                rest_b.remove(y)
                break
            s, l = sorted((x, y), key=len)
            if len(s) >= 3 and s[0] == l[0] and re.search(".*".join(map(re.escape, s)), l):
                near += 0.7
                rest_b.remove(y)
                break
    return min(1.0, (len(same) + near) / (len(ca | cb) - near))


def shared_values(a: dict, b: dict) -> float:
    """Estimated share of the values that two fields have in common."""
    return float(np.mean([x == y for x, y in zip(a["sketch"], b["sketch"])]))


def value_similarity(a: dict, b: dict) -> float | None:
    """0 to 1, or None for fields of different classes, which can't be the same
    quantity. Numbers compare by their level on a ratio scale, text by shared
    values, and by its class where the values move on."""
    if a["cls"] != b["cls"]:
        return None
    if a["cls"] == "number":
        if np.isnan(a["level"]) or np.isnan(b["level"]):
            return 0.5
        return float(np.exp(-abs(a["level"] - b["level"]) / 0.3))
    shared = shared_values(a, b)
    return 0.6 + 0.4 * shared if a["cls"] != "text" else 0.3 + 0.7 * shared


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of rows to columns with the greatest sum (Hungarian method
    with potentials)."""
    n, m = score.shape
    if n > m:
        return sorted((r, c) for c, r in assign(score.T))
    cost = -score
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~done[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < least[free]
            least[free[better]], back[free[better]] = slack[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


def match(removed: list[dict], added: list[dict], least: float = 0.45, synonyms: frozenset = frozenset()) -> dict[str, str]:
    """Renames among the fields of one step: name before to name after."""
    if not removed or not added:
        return {}
    score = np.zeros((len(removed), len(added)))
    for i, a in enumerate(removed):
        for j, b in enumerate(added):
            if (v := value_similarity(a, b)) is not None:
                n = name_similarity(a["field"], b["field"], synonyms)
                s = 0.5 * n + 0.5 * v
                # numbers and flags have values in common by chance
                told = n > 0 or (a["cls"] not in ("number", "flag") and shared_values(a, b) >= SHARED)
                score[i, j] = s if s >= least and told else 0.0
    return {removed[i]["field"]: added[j]["field"] for i, j in assign(score) if score[i, j] > 0}


def _leaf(kind: Column, text: Column) -> Column:
    """The plain value in a field, for profiles: of an object or array its first
    number, else its first text."""
    first_number = F.regexp_extract(text, r'[:\[,]\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*[,}\]]', 1)
    first_text = F.regexp_extract(text, r'[:\[]\s*"([^"]*)"', 1)
    nested = F.when(first_number != "", first_number).otherwise(first_text)
    return F.when(kind.isin("object", "array"), nested).otherwise(text)


def entries(rows: DataFrame, *, row: str, file: str, record: str) -> DataFrame:
    """(row, file, field, kind, text, leaf): one row per field with a value; text
    is the whole value, leaf the plain one in it. Rows that repeat a row id have
    to be equal and count once. A record that is NULL, not valid JSON or not an
    object has no fields, and a field that is null in a record has no value
    there."""
    one = rows.select(F.col(row).alias("row"), F.col(file).alias("file"), F.col(record).alias("text")).distinct()
    parsed = one.select("row", "file", parse_json(F.col("text")).alias("v")).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    spread = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    typed = spread.select("row", "file", F.col("key").alias("field"), F.substring(F.schema_of_variant("value"), 1, 6).alias("t"), F.try_variant_get("value", "$", "string").alias("text"))
    t = F.col("t")
    kind = F.when(t == "STRING", "string").when(t == "BOOLEA", "boolean").when(t == "OBJECT", "object").when(t == "ARRAY<", "array").when(t != "VOID", "number")
    return typed.select("row", "file", "field", kind.alias("kind"), "text").where("kind IS NOT NULL").withColumn("leaf", _leaf(F.col("kind"), F.col("text")))


def field_profiles(e: DataFrame) -> DataFrame:
    """One row of fixed size per file and field, by mergeable aggregates. Equal
    values of a field are looked at once."""
    plain, kind = F.col("leaf"), F.col("kind")
    low = F.lower(plain)
    # numbers need no pattern, and short texts no test for hashes
    number = F.when(kind == "number", plain.try_cast("double")).when(plain.rlike("^\\s*-?\\d"), F.regexp_extract(plain, r"^\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*[A-Za-z%]{0,12}\s*$", 1).try_cast("double"))
    word = low.isin("true", "false", "yes", "no", "y", "n", "on", "off")
    hexed = (kind != "number") & (F.length(plain) >= 16) & plain.rlike(r"^[0-9a-fA-F]{16,}$")
    version = (kind != "number") & F.contains(plain, F.lit(".")) & plain.rlike(r"^v?\d+\.\d+\.\d+")
    one = e.groupBy("file", "field", "kind", "leaf").agg(F.count("*").alias("m"))
    one = one.select("file", "field", "kind", "m", number.alias("number"), word.alias("word"), (word | low.isin("0", "1")).alias("bit"), hexed.alias("hexed"), F.length("leaf").alias("size"), version.alias("version"), F.xxhash64(low).alias("h"))
    many = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("m"))), F.lit(0))
    value = F.abs("number")
    logs = F.when((value > 0) & (value < float("inf")), F.ln(value))
    hashes = [F.min(F.xxhash64(F.lit(i), F.col("h"))).alias(f"h{i}") for i in range(HASHES)]
    return one.groupBy("file", "field").agg(
        F.sum("m").alias("n"), *[many(kind == t).alias(t) for t in TYPES], many(F.col("number").isNotNull()).alias("numeric"), many((kind == "boolean") | F.col("word")).alias("flags"),
        many(F.col("bit")).alias("binary"), many(F.col("hexed")).alias("hexed"), F.max(F.when(F.col("hexed"), F.col("size"))).alias("hex_size"), many(F.col("version")).alias("version"),
        (F.sum(logs * F.col("m")) / F.sum(F.when(logs.isNotNull(), F.col("m")))).alias("level"), *hashes,
    )


def _class(p: str = "") -> Column:
    n = F.col(f"{p}n") / 2
    return (
        F.when(F.col(f"{p}flags") > n, "flag").when(F.col(f"{p}hexed") > n, F.concat(F.lit("hex"), F.col(f"{p}hex_size").cast("string")))
        .when(F.col(f"{p}version") > n, "version").when((F.col(f"{p}binary") == F.col(f"{p}n")) & (F.col(f"{p}boolean") == 0), "bit").when(F.col(f"{p}numeric") > n, "number").otherwise("text")
    )


def steps(files: DataFrame, profiles: DataFrame, *, file: str, line: str, order: str) -> DataFrame:
    """Fields of a file against those of the file before it in its line: (line,
    order, file, field, before, after), where before and after are profiles,
    NULL where the field isn't there. The first file of a line has no step; a
    file without records has no fields."""
    w = Window.partitionBy("line").orderBy("order", "file")
    # as two columns of a file, which rows of the larger tables then join
    chain = files.select(F.col(file).alias("file"), F.col(line).alias("line"), F.col(order).alias("order")).distinct().withColumn("prev", F.lag("file").over(w)).where("prev IS NOT NULL")
    major = F.array_sort(F.array(*[F.struct((-F.col(t)).alias("n"), F.lit(i).alias("i")) for i, t in enumerate(TYPES)]))[0]["i"]
    kinds = F.array(*[F.lit(t) for t in TYPES])
    p = profiles.withColumn("type", kinds[major])
    # 1 as a number may stand for true, so bits count as flags when fields are compared
    cls = F.when(_class() == "bit", "flag").otherwise(_class())
    p = p.select("file", "field", F.struct("field", "type", cls.alias("cls"), "level", F.array(*[f"h{i}" for i in range(HASHES)]).alias("sketch")).alias("p"))
    before = chain.select("file", F.col("prev")).join(p.withColumnRenamed("file", "prev"), "prev").select("file", "field", F.col("p").alias("before"))
    after = chain.select("file").join(p, "file").select("file", "field", F.col("p").alias("after"))
    return before.join(after, ["file", "field"], "full_outer").join(chain.select("file", "line", "order"), "file")


def _moved(step: DataFrame) -> DataFrame:
    """Per step its vanished and new fields. They are as many as the step has
    distinct names, which the text of its records bounds."""
    return step.where("before IS NULL OR after IS NULL").groupBy("line", "order", "file").agg(F.collect_list("before").alias("removed"), F.collect_list("after").alias("added"))


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        for line, order, file, removed, added in pdf[["line", "order", "file", "removed", "added"]].itertuples(index=False):
            removed, added = (sorted((dict(r.asDict() if hasattr(r, "asDict") else r) for r in x), key=lambda r: r["field"]) for x in (removed, added))
            for r in removed + added:
                r["level"] = np.nan if r["level"] is None else r["level"]
            yield line, order, file, removed, added


def learn_synonyms(moved: DataFrame, *, least: int = 3, most: int = 10_000) -> frozenset:
    """Words that stand for each other: those in which names differ that share
    another word and are matched by their values, in at least so many lines. The
    most frequent are kept, up to most pairs, which bounds what the driver
    holds."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for line, _, _, removed, added in _fields(batches):
            for a, b in match(removed, added).items():
                x, y = rest_words(a, b)
                if set(words(a)) & set(words(b)):
                    out += [(line, *sorted((p, q))) for p in x for q in y]
        yield pd.DataFrame(out, columns=["line", "x", "y"])

    pairs = moved.mapInPandas(learn, f"line {dict(moved.dtypes)['line']}, x string, y string").groupBy("x", "y").agg(F.count_distinct("line").alias("n")).where(F.col("n") >= least)
    return frozenset((r["x"], r["y"]) for r in pairs.orderBy(F.desc("n"), "x", "y").limit(most).collect())


def changes(step: DataFrame) -> DataFrame:
    """(line, order, file, field_name, change_kind, new_name, old_type,
    new_type). Renames are matched twice, the second time with the synonyms that
    the first has shown."""
    kept = step.where("before IS NOT NULL AND after IS NOT NULL AND before.type != after.type").select(
        "line", "order", "file", F.col("field").alias("field_name"), F.lit("type_changed").alias("change_kind"), F.col("field").alias("new_name"), F.col("before.type").alias("old_type"), F.col("after.type").alias("new_type")
    )
    moved = materialise(_moved(step))
    synonyms = learn_synonyms(moved)

    def renames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for line, order, file, removed, added in _fields(batches):
            pairs = match(removed, added, synonyms=synonyms)
            new = {r["field"]: r for r in added}
            for r in removed:
                f = r["field"]
                if f in pairs:
                    out.append((line, order, file, f, "renamed", pairs[f], r["type"], new[pairs[f]]["type"]))
                    if r["type"] != new[pairs[f]]["type"]:
                        out.append((line, order, file, f, "type_changed", pairs[f], r["type"], new[pairs[f]]["type"]))
                else:
                    out.append((line, order, file, f, "removed", None, r["type"], None))
            taken = set(pairs.values())
            out += [(line, order, file, r["field"], "added", r["field"], None, r["type"]) for r in added if r["field"] not in taken]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    names = ["line", "order", "file", "field_name", "change_kind", "new_name", "old_type", "new_type"]
    kinds = dict(moved.dtypes)
    schema = f"line {kinds['line']}, `order` {kinds['order']}, file {kinds['file']}, field_name string, change_kind string, new_name string, old_type string, new_type string"
    return kept.unionByName(moved.mapInPandas(renames, schema))


def drift(files: DataFrame, rows: DataFrame, *, file: str = "file_id", line: str = "line_id", order: str = "seq_no", row: str = "raw_id", record: str = "record") -> DataFrame:
    """Every change of a file's fields against the file before it in its line;
    see changes(). The type of a field is the JSON type of most of its values
    (of equally many, the first in the order of TYPES)."""
    e = entries(rows, row=row, file=file, record=record)
    # profiles are read as those of the file and of the one before it
    return changes(steps(files, materialise(field_profiles(e)), file=file, line=line, order=order))


def canonical_names(found: DataFrame, e: DataFrame, files: DataFrame, *, file: str, line: str, family: str) -> DataFrame:
    """(line, field, name): names that a line's renames join are one quantity;
    its name is the one that most files of the family use. A line's renames meet
    in one task; they are as many as it has distinct renames."""
    pairs = found.where("change_kind = 'renamed'").select("line", "field_name", "new_name").distinct()
    used = e.select("file", "field").distinct().join(files.select(F.col(file).alias("file"), F.col(line).alias("line"), F.col(family).alias("family")).distinct(), "file")
    votes = used.groupBy("family", "field").agg(F.count("*").alias("votes"))
    per_line = used.select("line", "family", "field").distinct().join(votes, ["family", "field"])
    voted = per_line.groupBy("line").agg(F.collect_list(F.struct("field", "votes")).alias("fields")).join(pairs.groupBy("line").agg(F.collect_list(F.struct("field_name", "new_name")).alias("pairs")), "line", "left")

    def join_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for line_id, fields, pairs in pdf[["line", "fields", "pairs"]].itertuples(index=False):
                root = {f["field"]: f["field"] for f in fields}

                def find(x: str) -> str:
                    while root.setdefault(x, x) != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for p in pairs if pairs is not None else ():
                    root[find(p["field_name"])] = find(p["new_name"])
                best: dict[str, tuple] = {}
                for f in fields:
                    r = find(f["field"])
                    best[r] = min(best.get(r, (1, "")), (-f["votes"], f["field"]))
                out += [(line_id, f["field"], best[find(f["field"])][1]) for f in fields]
            yield pd.DataFrame(out, columns=["line", "field", "name"])

    return voted.mapInPandas(join_names, f"line {dict(voted.dtypes)['line']}, field string, name string")


def unify(files: DataFrame, rows: DataFrame, *, file: str = "file_id", line: str = "line_id", order: str = "seq_no", family: str = "family", row: str = "raw_id", record: str = "record", wide: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """All records as one table, nothing lost: row, file, line, family, a column
    for each of wide (canonical name, SQL type), other, a map of the remaining
    canonical fields to their whole values (objects and arrays as JSON), and
    reported, a list of (field, name, value, reason) of what doesn't stand whole
    in these: doubled (another field of the record has the same canonical name
    and stands; the one of that name itself comes first, then the first by
    name), misfit (a value that isn't of its column's type, which is NULL there)
    and nested (an object or array of whose values the first plain one stands in
    the column). Records that repeat a row id have to be equal."""
    e = materialise(entries(rows, row=row, file=file, record=record))
    names = canonical_names(changes(steps(files, materialise(field_profiles(e)), file=file, line=line, order=order)), e, files, file=file, line=line, family=family)
    home = files.select(F.col(file).alias("file"), F.col(line).alias("line"), F.col(family).alias("family")).distinct()
    long = e.join(home, "file").join(names, ["line", "field"])
    # a number with a unit counts as the number
    plain = F.when(F.col("leaf").rlike(r"^\s*-?\d+(\.\d+)?([eE][-+]?\d+)?\s+[A-Za-z%]+\s*$"), F.regexp_extract("leaf", r"^\s*(\S+)", 1)).otherwise(F.col("leaf"))
    item = F.struct("name", (F.col("field") != F.col("name")).alias("alias"), "field", "text", plain.alias("plain"), F.col("kind").isin("object", "array").alias("nested"))
    grouped = long.groupBy("row", "file", "line", "family").agg(F.array_sort(F.collect_list(item)).alias("p"))
    stands = lambda x, i: (i == 0) | (F.get("p", i - 1)["name"] != x["name"])
    grouped = grouped.withColumns({"first": F.filter("p", stands), "second": F.filter("p", lambda x, i: ~stands(x, i))})
    wide_names = [n for n, _ in wide]
    is_wide = lambda x: x["name"].isin(*wide_names) if wide_names else F.lit(False)
    of = lambda n: F.get(F.filter("first", lambda x: x["name"] == n), F.lit(0))
    grouped = grouped.withColumns({f"tm_{i}": of(n) for i, n in enumerate(wide_names)})
    told = lambda x, why: F.struct(x["field"].alias("field"), x["name"].alias("name"), x["text"].alias("value"), F.lit(why).alias("reason"))
    reports = [F.transform("second", lambda x: told(x, "doubled"))]
    for i, (_, t) in enumerate(wide):
        x = F.col(f"tm_{i}")
        why = F.when(x["plain"].isNotNull() & x["plain"].try_cast(t).isNull(), "misfit").when(x["nested"], "nested")
        reports.append(F.when(why.isNotNull(), F.array(F.struct(x["field"].alias("field"), x["name"].alias("name"), x["text"].alias("value"), why.alias("reason")))).otherwise(F.array().cast("array<struct<field:string,name:string,value:string,reason:string>>")))
    rest = F.filter("first", lambda x: ~is_wide(x))
    return grouped.select(
        "row", "file", "line", "family", *[F.col(f"tm_{i}")["plain"].try_cast(t).alias(n) for i, (n, t) in enumerate(wide)],
        F.map_from_arrays(F.transform(rest, lambda x: x["name"]), F.transform(rest, lambda x: x["text"])).alias("other"), F.concat(*reports).alias("reported"),
    )
