"""Secret scans with character Markov models, DataFrame expressions only.

Known forms (assignments, access keys, long hexadecimal runs) are found by pattern. Any
other run of key characters, and what is left of one beside a known form, is judged by two
character Markov models, one of random strings and one of ordinary identifiers, by their
log-likelihood ratio. The models are counted from labelled samples: random are the known
forms' values in a bounded sample of documents and digests made by rule, ordinary are the
other runs of those documents, of any length, and identifiers made of them, but those that a
first model calls random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.session import stage

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST = 8  # characters of a run to be judged; in fewer the ratio cannot tell
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ANY_RUN = r"[A-Za-z0-9+/_=-]{4,}"
KINDS = ("assign", "access", "hex", "markov")
# Fixed value: the characters that the models know, in the order of their numbers.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_DOCS = 4000
DIGESTS = 2000
COMPOUND = 16  # one in so many words gives an identifier of each form, made by rule with the next
SMOOTH = 0.5  # of counts of characters; pairs have as much for all, by the shares of their second
TOTAL_RATIO = 12.0  # natural log, over the whole run
MEAN_RATIO = 0.25  # and per character

Model = list[float]


def _found(text: Column, pattern: str, test: Column) -> Column:
    """All matches of ``pattern``; only texts that pass ``test`` are searched."""
    return F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def _places(found: str, gaps: str, kind: int, keep: Column | None = None) -> Column:
    """(start, kind, end) of matches, code points, from the text between them; of those that
    ``keep`` marks. The others are passed without copying what is kept so far."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    items = F.sequence(F.lit(0), F.size(found) - 1)
    if keep is None:
        items = F.transform(items, lambda i: F.struct(i.alias("i"), F.lit(True).alias("keep")))
    else:
        items = F.zip_with(items, keep, lambda i, k: F.struct(i.alias("i"), k.alias("keep")))

    def step(acc, x):
        start = acc["at"] + F.length(F.get(gaps, x["i"]))
        end = start + F.length(F.get(found, x["i"]))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(items, begin, step)["out"]).otherwise(empty)


def _blanked(text: Column, pattern: str, test: Column, keep: Column | None = None) -> Column:
    """``text`` with spaces for all characters of the matches that ``keep`` marks."""
    blank = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda x, i: F.repeat(F.lit(" "), F.length(x)) if keep is None else F.when(F.get(keep, i), F.repeat(F.lit(" "), F.length(x))).otherwise(x),
    )
    both = F.zip_with(F.split(text, pattern, -1), F.concat(blank, F.array(F.lit(""))), lambda g, b: F.concat(g, b))
    return F.when(test, F.array_join(both, "")).otherwise(text)


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (row, text) with ``base``: spans of the known forms, by start, then kind, and
    ``rest``: the text with spaces in their places."""
    text = F.col("text")
    assign = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    looked = rows.select(
        "row", "text",
        _found(text, ASSIGN, text.rlike(ASSIGN)).alias("f0"),
        F.when(text.rlike(ASSIGN), F.transform(assign, lambda v: F.length(v) >= 6)).alias("long"),
        _found(text, ACCESS, text.contains("AKIA")).alias("f1"),
        _found(text, HEX, text.rlike(HEX)).alias("f2"),
    )
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        looked = looked.withColumn(f"g{k}", F.when(F.size(f"f{k}") > 0, F.split("text", pattern, -1)))
    spans = [_places(f"f{k}", f"g{k}", k, F.col("long") if k == 0 else None) for k in range(3)]
    looked = looked.withColumn("rest", _blanked(text, ASSIGN, F.size("f0") > 0, F.col("long")))
    for k, pattern in ((1, ACCESS), (2, HEX)):
        looked = looked.withColumn("rest", _blanked(F.col("rest"), pattern, F.size(f"f{k}") > 0))
    return looked.select("row", "text", F.sort_array(F.concat(*spans)).alias("base"), "rest")


def _outside(span: Column, spans: str) -> Column:
    return ~F.exists(spans, lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"]))


def sample_runs(docs: DataFrame) -> DataFrame:
    """(random, run): labelled runs of a bounded sample of documents, and digests."""
    spark = docs.sparkSession
    parts = max(1, -(-docs.count() // SAMPLE_DOCS))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).where("text is not null")
    text = F.col("text")
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    known = F.concat(value, *[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ACCESS, HEX)])
    random = some.select(F.explode(known).alias("run"))
    rest = text
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    words = some.select(F.regexp_extract_all(rest, F.lit(ANY_RUN), F.lit(0)).alias("words"))
    after = F.slice("words", 2, F.size("words"))
    plain = words.select(F.explode(F.zip_with("words", after, lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("p"))
    x, y, turn = F.col("p.x"), F.coalesce("p.y", "p.x"), F.pmod(F.xxhash64("p.x", "p.y"), F.lit(COMPOUND))
    snake = F.concat_ws("_", x, y)
    forms = (F.upper(x), F.concat(F.lower(x), F.initcap(y)), snake, F.upper(snake), F.concat_ws("/", x, y))
    plain = plain.select(F.explode(F.array(x, *[F.when(turn == k, form) for k, form in enumerate(forms)])).alias("run"))
    plain = plain.where("run is not null")
    made = spark.range(DIGESTS).select(F.sha2(F.col("id").cast("string"), 256).alias("hex"))
    made = made.select(F.explode(F.array("hex", F.base64(F.unhex("hex")))).alias("run"))
    return random.unionByName(made).select(F.lit(True).alias("random"), "run").unionByName(
        plain.select(F.lit(False).alias("random"), "run")
    )


def _codes(run: Column) -> Column:
    """Numbers of the known characters of a run."""
    known = F.lit(ALPHABET)
    return F.filter(F.transform(F.split(run, ""), lambda c: F.when(c != "", F.instr(known, c)).otherwise(0)), lambda n: n > 0)


def train(docs: DataFrame) -> Model:
    """Log-likelihood ratios of character pairs, row by row; the bounded table of all pairs.

    A first model takes all other runs as ordinary; the model leaves out those that it calls
    random, as secrets of no known form are among them."""
    runs = stage(sample_runs(docs), "runs")
    first = _ratios(runs)
    return _ratios(runs.where(F.col("random") | (F.length("run") < LEAST) | ~judged(F.col("run"), first)))


def _ratios(runs: DataFrame) -> Model:
    codes = runs.select("random", _codes(F.col("run")).alias("codes")).where(F.size("codes") > 1)
    pairs = codes.select(
        "random", F.explode(F.arrays_zip(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes")))).alias("p")
    ).select("random", F.col("p.0").alias("a"), F.col("p.1").alias("b"))
    n = len(ALPHABET)
    counts = {True: [0.0] * (n * n), False: [0.0] * (n * n)}
    for r in pairs.groupBy("random", "a", "b").count().collect():
        counts[r["random"]][(r["a"] - 1) * n + r["b"] - 1] += r["count"]
    logs = {}
    for label, c in counts.items():
        seconds = [SMOOTH + sum(c[b::n]) for b in range(n)]
        shares = [x / sum(seconds) for x in seconds]
        logs[label] = [
            math.log((c[a * n + b] + SMOOTH * n * shares[b]) / (sum(c[a * n : a * n + n]) + SMOOTH * n))
            for a in range(n)
            for b in range(n)
        ]
    return [round(x - y, 4) for x, y in zip(logs[True], logs[False], strict=True)]


def judged(run: Column, model: Model) -> Column:
    """Whether a run is random by both limits."""
    table = F.split(F.lit(" ".join(map(str, model))), " ").cast("array<double>")
    n = len(ALPHABET)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    folded = F.aggregate(
        _codes(run),
        start,
        lambda acc, c: F.struct(
            (acc["sum"] + F.when(acc["last"] > 0, F.get(table, (acc["last"] - 1) * n + c - 1)).otherwise(0.0)).alias("sum"),
            c.alias("last"),
        ),
        lambda acc: acc["sum"],
    )
    return (folded > TOTAL_RATIO) & (folded > MEAN_RATIO * F.length(run))


def all_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(row, text, base, spans): each row of ``docs`` as a struct, its whole text (null:
    empty), the known forms, and these with the runs outside of them that the models call random."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    based = base_spans(rows)
    rest = F.col("rest")
    looked = based.withColumn("f3", _found(rest, RUN, rest.rlike(RUN)))
    looked = looked.withColumn("g3", F.when(F.size("f3") > 0, F.split("rest", RUN, -1)))
    more = _places("f3", "g3", 3, F.transform("f3", lambda run: judged(run, model)))
    looked = looked.select("row", "text", "base", more.alias("more"))
    more = F.filter("more", lambda x: _outside(x, "base"))
    return looked.select("row", "text", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) per row of ``docs``.

    A null text is empty; an empty text has no span and the digest of the empty text. Null
    ids and repeated rows are rows like others, and other columns are ignored. An empty
    table gives no row; its models know digests only. ``model`` is by default trained on
    ``docs``.
    """
    docs = docs.select("doc_id", "text")
    found = all_spans(docs, model or train(docs))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "row.doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redacted(docs: DataFrame, model: Model | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs``, all columns, with each stretch of secret characters replaced by ``mark``;
    ``n_chars``, where there is such a column, counts the new text. Null texts stay null."""
    found = all_spans(docs, model or train(docs.select("doc_id", "text")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        kept = F.when(fresh, F.substring("text", acc["at"] + 1, s["start"] - acc["at"]))
        more = F.when(fresh, F.array(kept, F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    def rest(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"] + 1, F.length("text")))

    clean = F.when(F.size("spans") > 0, F.aggregate("spans", begin, step, rest)).otherwise(F.col("row.text"))
    told = found.select("row", clean.alias("clean"))
    kinds = dict(docs.dtypes)
    columns = []
    for name in docs.columns:
        value = F.col("row").getField(name)
        if name == "text":
            value = F.col("clean")
        elif name == "n_chars":
            value = F.when(F.col("clean").isNotNull(), F.length("clean").cast(kinds[name])).otherwise(value)
        columns.append(value.alias(name))
    return told.select(*columns)
