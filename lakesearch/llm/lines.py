"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is what stands between line feeds; lines are compared as their words, runs of
anything but blanks, tabs and carriage returns, in lower case.  Lines without a word
are kept and not counted.  Two lines are
near if one word put in, left out or exchanged turns one into the other (an edit
distance of at most one word) and both have `MIN_WORDS` words or more, so three
quarters of a line stay as they are; shorter lines only meet exact copies, as one edit
there leaves half a line or nothing (`least` is an option of every function).  A line goes if an earlier one, by place, is equal or near,
whether that one stays or not.  A place is (doc_id, hash of the text, row, line), so
every row of the table is a document of its own: rows that repeat a doc_id stand one
after the other, and a line of one never takes a line of another with it.

1. Equal lines are one class, known by a hash of 128 bits, with its first place.
2. Pigeonhole: one edit leaves the first or the last half of a line as it is.  Only
   classes that share a half, at the right lengths, with another class go on; this
   drops no near pair, and nearly all classes.
3. Every variant that lacks one word gets a key: for an exchange, the place and
   what stands before and after it; for a word more or less, the place, and what
   stands before and after it in the longer line, or on both sides of it in the
   shorter.  The two parts are hashed by running exclusive-or over the words, so a
   line of n words costs n steps and not n * n.
4. Lines with a key in common are near, each to each, so the group's earliest is
   found by a minimum, and no pair but (line, earliest) is formed; the word edit
   distance of these pairs is then verified on the words.

Texts are split, normalised and hashed once; what follows reads the hashes, and the
texts of only those documents where a class of step 2 first stands.  Steps 2 to 4 see
classes and not lines, so a line that a third of all rows have is one row there.

A null text has no lines.  Of rows equal in doc_id and text one is the first, and the
others lose every line with a word.  A null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 4
SIEVE = 1 << 20
HOT = 1 << 14
SPACE = r"[ \t\r]+"


def normal(line: Column) -> Column:
    """The words of a line in lower case, joined by one space; the regular expression only where it is needed."""
    low = F.lower(line)
    odd = F.contains(low, F.lit("  ")) | F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r"))
    return F.trim(F.when(odd, F.regexp_replace(low, SPACE, " ")).otherwise(low))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """row, doc_id, code, line, norm, n (its words), h1, h2 of every line with a word, and of rows without any with a null line.

    `row` names a column that numbers the rows; without it they are numbered here, so the result must be saved.
    """
    # normalised inside the array, so that no later step repeats the expression
    whole = F.transform(F.split(text, "\n", -1), normal)
    numbered = F.filter(F.transform(whole, lambda x, i: F.struct(i.alias("line"), x.alias("norm"))), lambda x: x["norm"] != "")
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias("row"), F.col(key).alias("doc_id"), F.xxhash64(text).alias("code"), numbered.alias("all"))
    rows = rows.select("row", "doc_id", "code", F.explode_outer("all").alias("l")).select("row", "doc_id", "code", "l.line", "l.norm")
    n = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return rows.withColumns({"n": n, "h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(7), "norm")})


def _halves(m: Column) -> list[Column]:
    """Keys of the first and the last half that a line shares with lines that come from the same m words."""
    h = F.floor(m / 2).cast("int")
    part = lambda count: F.call_function("substring_index", F.col("norm"), F.lit(" "), count.cast("int"))
    return [F.xxhash64(F.lit("first"), m, part(h)), F.xxhash64(F.lit("last"), m, part(h - m))]


def hashed(docs: DataFrame, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """row, doc_id, code, line, n, h1, h2 and k0 to k3, the keys of halves, of every line with a word; saved."""
    long_enough = F.col("n") >= least
    keys = [F.when(long_enough & (m >= least), k) for m in (F.col("n"), F.col("n") - 1) for k in _halves(m)]
    return C.save(lines(docs, key, text, row).select("row", "doc_id", "code", "line", "n", "h1", "h2", *(k.alias(f"k{i}") for i, k in enumerate(keys))), "lines")


def sieved(rows: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """`rows` without most of those whose `column` is not among `name` of `wanted`, before a join that is exact.

    What is broadcast are SIEVE cells at most, however large `wanted` is; once they are
    all taken nothing is held back, and the join is as it would be without.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE)).alias("_cell")
    cells = wanted.select(cell(name)).distinct()
    return rows.withColumn("_cell", cell(column)).join(F.broadcast(cells), "_cell", "left_semi").drop("_cell")


def classes_of(rows: DataFrame) -> DataFrame:
    """h1, h2, first place, number of copies, n and the keys of halves of each class of equal lines; saved."""
    place = F.min(F.struct("doc_id", "code", "row", "line")).alias("place")
    return C.save(rows.where("line is not null").groupBy("h1", "h2").agg(place, F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3"))), "classes")


def near_lines(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """h1, h2 of the classes that go because an earlier one is near."""
    # side: 0 first half of n words, 1 last half of n, 2 first half of n - 1, 3 last half of n - 1
    shared = classes.select("h1", "h2", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("side", "key")).where("key is not null")
    equal = F.when(F.col("side") < 2, F.col("h1"))
    crowd = shared.groupBy("key").agg(F.min(equal).alias("least"), F.max(equal).alias("most"), F.max(F.col("side") >= 2).alias("longer")).where("least < most or (least is not null and longer)")
    crowd = C.save(crowd.select("key", (F.col("least") < F.col("most")).alias("_several"), "longer"), "crowd")
    some = sieved(shared, "key", crowd, "key").join(crowd, "key").withColumns({"exchange": (F.col("side") < 2) & F.col("_several"), "more": F.col("longer")}).where("exchange or more")
    flag = lambda c, side: F.max(F.col(c) & (F.col("side") == side))
    wanted = some.groupBy("h1", "h2").agg(*(flag(c, s).alias(f"{c}{s}") for c, s in (("exchange", 0), ("exchange", 1), ("more", 0), ("more", 1), ("more", 2), ("more", 3))))

    # the words of those classes, from the documents where they first stand
    flags = [c for c in wanted.columns if c not in ("h1", "h2")]
    first = wanted.join(classes.select("h1", "h2", "n", "place"), ["h1", "h2"]).withColumn("_of", F.xxhash64("place.doc_id", "place.code"))
    first = C.save(first.groupBy("_of").agg(F.collect_list(F.struct("h1", "h2", "n", "place", *flags)).alias("_wanted")), "wanted")  # one text's lines
    # of rows equal in doc_id and text the first does: they all have the lines
    texts = sieved(docs.select(F.xxhash64(F.col(key), F.xxhash64(text)).alias("_id"), F.col(text).alias("_text")), "_id", first, "_of")
    texts = texts.join(first, F.col("_id") == F.col("_of"))
    found = texts.select(F.split("_text", "\n", -1).alias("_lines"), F.explode("_wanted").alias("w")).select("w.*", normal(F.get("_lines", F.col("w.place.line"))).alias("norm"))
    kept = C.save(found.where((F.xxhash64("norm") == F.col("h1")) & (F.xxhash64(F.lit(7), "norm") == F.col("h2"))).dropDuplicates(["h1", "h2"]), "candidates")

    # hashes of what stands before and from each word on; one row more for the end
    spread = kept.select("h1", "h2", "place", "n", *flags, F.posexplode(F.concat(F.split("norm", " "), F.array(F.lit("")))).alias("p", "word"))
    spread = spread.withColumn("start", F.when(F.col("p") < F.col("n"), F.xxhash64("word", "p")).otherwise(0)).withColumn("end", F.when(F.col("p") < F.col("n"), F.xxhash64("word", F.lit("end"), F.col("n") - F.col("p"))).otherwise(0))
    line = Window.partitionBy("h1", "h2")
    ahead = line.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumns({"before": F.coalesce(F.bit_xor("start").over(ahead), F.lit(0)), "gone": F.coalesce(F.bit_xor("end").over(ahead), F.lit(0)), "all": F.bit_xor("end").over(line)})
    at = F.col("all").bitwiseXOR(F.col("gone"))  # of the words from p on
    after = at.bitwiseXOR(F.col("end"))

    in_last = F.col("p") >= F.floor(F.col("n") / 2)
    in_last_short = F.col("p") >= F.floor((F.col("n") - 1) / 2)
    inner = F.col("p") < F.col("n")
    one = lambda when, kind, m, rest: F.when(when, F.struct(F.lit(kind).alias("kind"), m.alias("m"), rest.alias("rest")))
    variants = F.array(
        one(inner & ((F.col("exchange0") & in_last) | (F.col("exchange1") & ~in_last)), "exchange", F.col("n"), after),
        one((F.col("more0") & in_last) | (F.col("more1") & (F.col("p") <= F.floor(F.col("n") / 2))), "more", F.col("n"), at),
        one(inner & ((F.col("more2") & in_last_short) | (F.col("more3") & (F.col("p") <= F.floor((F.col("n") - 1) / 2)))), "more", F.col("n") - 1, after),
    )
    keyed = spread.select("h1", "h2", "place", "p", "before", F.explode(F.array_compact(variants)).alias("v")).select("h1", "h2", "place", "v.kind", "v.m", "p", "before", "v.rest")
    keyed = C.save(keyed, "variants")
    key = ["kind", "m", "p", "before", "rest"]
    met = keyed.groupBy(*key).agg(F.min(F.struct("place", "h1", "h2")).alias("first"), F.count("*").alias("lines")).where("lines > 1")
    partner = keyed.join(met, key).where(F.col("first.place") < F.col("place")).select("h1", "h2", F.col("first.h1").alias("g1"), F.col("first.h2").alias("g2")).distinct()

    a = kept.select("h1", "h2", F.split("norm", " ").alias("a"))
    b = kept.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.split("norm", " ").alias("b"))
    return partner.join(a, ["h1", "h2"]).join(b, ["g1", "g2"]).where(within_one("a", "b")).select("h1", "h2").distinct()


def within_one(a: str, b: str) -> Column:
    """Whether the word edit distance of two arrays is at most one: the equal start and the equal end leave one word at most."""
    longest = F.greatest(F.size(a), F.size(b))

    def same(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), F.lit(False))
        return F.when(differs == 0, longest).otherwise(differs - 1)

    one_longer = F.abs(F.size(a) - F.size(b)) <= 1
    return one_longer & (same(F.col(a), F.col(b)) + same(F.reverse(a), F.reverse(b)) >= longest - 1)


def _judge(docs: DataFrame, least: int, key: str, text: str, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(all lines with a word and rows without any, the lines that go with why)."""
    rows = hashed(docs, least, key, text, row)
    classes = classes_of(rows)
    near = near_lines(docs, classes, key, text).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    first = classes.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("place").alias("first"), "copies")
    first = C.save(first.join(near, (F.col("f1") == F.col("n1")) & (F.col("f2") == F.col("n2")), "left").where("copies > 1 or n1 is not null"), "judged")
    narrow = sieved(rows.select("row", "doc_id", "line", "h1", "h2"), "h1", first, "f1")
    same = (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))
    # classes that hold one line in HOT or more, HOT at most, are broadcast: no key of the other join is heavy
    least_copies = classes.agg(F.sum("copies") / HOT).first()[0] or 0.0
    done = narrow.join(F.broadcast(first.where(F.col("copies") >= least_copies)), same).union(narrow.join(first.where(F.col("copies") < least_copies), same))
    leads = (F.col("row") == F.col("first.row")) & (F.col("line") == F.col("first.line"))
    why = F.when(~leads, "exact").when(F.col("n1").isNotNull(), "near")
    return rows, done.select("row", "doc_id", "line", why.alias("why")).where("why is not null")


def dropped(docs: DataFrame, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a number of its own for each row), doc_id, line and why ('exact' or 'near') of every line that goes."""
    return _judge(docs, least, key, text)[1]


def _summed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """row, doc_id, n_lines, n_exact, n_near and dropped_lines of every row."""
    counts = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("line").alias("n_lines"))
    found = gone.groupBy("row").agg(F.count_if(F.col("why") == "exact").alias("n_exact"), F.count_if(F.col("why") == "near").alias("n_near"), F.array_sort(F.collect_list("line")).alias("dropped_lines"))
    done = counts.join(found, "row", "left")
    return done.select("row", "doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_exact", "n_near")), F.coalesce("dropped_lines", F.array().cast("array<int>")).alias("dropped_lines"))


def summary(docs: DataFrame, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_exact, n_near and dropped_lines (from 0, ascending) of every row of `docs`."""
    return _summed(*_judge(docs, least, key, text)).drop("row")


def drop_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """`docs` with the text of the lines that stay; n_chars follows if it is there.  The rows are numbered and saved first."""
    held = C.save(docs.select(C.packed(docs), "doc_id", "text", F.monotonically_increasing_id().alias("_number")), "numbered")
    gone = _summed(*_judge(held, least, "doc_id", "text", "_number")).select(F.col("row").alias("_of"), F.col("dropped_lines").alias("_gone"))
    stay = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("_gone", i))
    text = F.when(F.size("_gone") > 0, F.array_join(stay, "\n")).otherwise(F.col("text"))
    again = {"text": text, "n_chars": F.length(text).cast("long")}
    done = held.join(gone, F.col("_number") == F.col("_of"))
    return done.select(*(again[c].alias(c) if c in again else F.col("_row")[c].alias(c) for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(C.documents(spark, sf_dir))


ORACLE_SQL = f"""
with docs as materialized (select doc_id, text, row_number() over (order by doc_id nulls first, text nulls first) as rid from documents),
l as (select rid, i - 1 as line, string_split(trim(regexp_replace(lower(x[i]), '{SPACE}', ' ', 'g')), ' ') as w
  from (select rid, string_split(text, chr(10)) as x from docs where text is not null), lateral (select unnest(range(1, len(x) + 1)) as i) y),
rows_ as (select * from l where w <> ['']),
cls as (select w, len(w) as n, min(struct_pack(rid := rid, line := line)) as first from rows_ group by w),
big as (select * from cls where n >= {MIN_WORDS}),
half as (select w, n, first, n as m, 0 as side, w[:n // 2] as part from big union all select w, n, first, n, 1, w[n // 2 + 1:] from big
  union all select w, n, first, n - 1, 0, w[:(n - 1) // 2] from big where n > {MIN_WORDS} union all select w, n, first, n - 1, 1, w[(n - 1) // 2 + 2:] from big where n > {MIN_WORDS}),
pair as (select distinct a.w as a, b.w as b, a.n as na, b.n as nb from half a join half b on a.m = b.m and a.side = b.side and a.part = b.part and a.first > b.first and a.w <> b.w),
near as (select distinct a as w from pair where
  (na = nb and len(list_filter(range(1, na + 1), lambda i: a[i] <> b[i])) = 1)
  or (na = nb + 1 and len(list_filter(range(1, na + 1), lambda i: list_concat(a[:i - 1], a[i + 1:]) = b)) > 0)
  or (nb = na + 1 and len(list_filter(range(1, nb + 1), lambda i: list_concat(b[:i - 1], b[i + 1:]) = a)) > 0)),
why as (select r.rid, r.line, case when struct_pack(rid := r.rid, line := r.line) > c.first then 'exact' when x.w is not null then 'near' end as why
  from rows_ r join cls c on r.w = c.w left join near x on r.w = x.w)
select d.doc_id, count(line)::bigint as n_lines, (count(*) filter (why = 'exact'))::bigint as n_exact, (count(*) filter (why = 'near'))::bigint as n_near,
  coalesce(list_sort(list(line::integer) filter (why is not null)), []::integer[]) as dropped_lines
from docs d left join why using (rid) group by d.rid, d.doc_id"""
