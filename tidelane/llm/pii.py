"""Personal data: base patterns, and contexts bootstrapped from what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import cut, let, lookup, spread_join

KINDS = ("email", "ip", "card", "phone")

#: Java forms of the base patterns. Each finds what the plain pattern finds: the possessive parts can never give back
#: what a later part needs, and the look-behinds only skip starts inside a run whose first place failed.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_MARK = "\x01"
#: Pieces of one chunk of a text's matches at least; chunks grow with the square root of their number.
_CHUNK = 64
#: Words of an instance at most: no base span of several words has more than 19 digits, and each word has one.
_WORDS = 19


def _holds(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut into gap, match, gap, ..., gap."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _walk(pieces: Column, entry) -> Column:
    """entry(piece, start, pieces, index) of every match, with starts in code points; nulls are left out.

    Starts are summed inside chunks of about the square root of the number of pieces, and over the chunks, so that
    the arrays that grow by copying stay short.
    """
    def of(p: Column) -> Column:
        # an even number, so that matches have odd places in every chunk
        per = (F.greatest(F.lit(_CHUNK), F.ceil(F.sqrt(F.size(p).cast("double")))).cast("int") / 2).cast("int") * 2
        return let(
            per,
            lambda n: let(
                F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / n).cast("int")), lambda c: F.slice(p, c * n + 1, n)),
                lambda chunks: matches(p, n, chunks),
            ),
        )

    def matches(p: Column, per: Column, chunks: Column) -> Column:
        sums = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), lambda a, x: a + F.length(x)))
        starts = F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )["out"]
        rows = F.transform(
            F.arrays_zip(chunks.alias("ch"), starts.alias("st")),
            lambda z, c: F.aggregate(
                z["ch"],
                F.struct(z["st"].alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<at:int,i:int>>").alias("out")),
                lambda a, x: F.struct(
                    (a["at"] + F.length(x)).alias("at"),
                    (a["i"] + 1).alias("i"),
                    F.when(a["i"] % 2 == 1, F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), (c * per + a["i"]).alias("i"))))).otherwise(a["out"]).alias("out"),
                ),
            )["out"],
        )
        return F.filter(F.transform(F.flatten(rows), lambda m: entry(F.element_at(p, m["i"] + 1), m["at"], p, m["i"])), lambda x: x.isNotNull())

    return let(pieces, of)


_SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, kind: str) -> Column:
    """Valid matches of a base pattern as (start, kind, end)."""
    pieces = _pieces(text, PATTERNS[kind])
    k = KINDS.index(kind)
    need = {"email": "@", "ip": ".", "card": None, "phone": "+"}[kind]

    def entry(x: Column, at: Column, _p: Column, _i: Column) -> Column:
        return F.when(_holds(kind, x), F.struct(at.alias("start"), F.lit(k).alias("kind"), (at + F.length(x)).alias("end")))

    some = text.rlike("[0-9]") if need is None else text.contains(need)
    return F.when(some, _walk(pieces, entry)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _join(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _shape(x: Column) -> Column:
    """A token's form: digits as 9, letters as a, runs of either cut to one; outer punctuation goes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$", ""), "[A-Za-z]+", "a"), "[0-9]+", "9")


def _tokens(text: Column, base: Column) -> Column:
    """Instances: start, end (outer punctuation apart), the words around them, form, hash of the text, kind, and longest.

    A token is a word with a digit or @; tokens in a row that only spaces, digits and ().- part are one run. A token
    that a base span starts in gives one instance, the tokens that the span covers, of the span's kind. Any other one
    that no base span touches gives an instance of kind -1 for each number of tokens from it on, up to _WORDS and the
    next base span; `longest` marks the last of them.
    """
    pieces = _pieces(text, r"(?<!\S)\S*[0-9@]\S*")
    edge = r"^[^A-Za-z0-9+@]+"

    def joined(p: Column, i: Column) -> Column:
        """Whether the token at place i and the next one are of a run."""
        return F.coalesce(
            F.concat(
                F.substring(F.get(p, i), -1, 1),
                F.get(p, i + 1),
                F.substring(F.get(p, i + 2), 1, 1),
            ).rlike(r"^[0-9().-][\x20().-]+[0-9().-]$"),
            F.lit(False),
        )

    def runs(p: Column, i: Column) -> Column:
        """The texts of the first, the first two, ... tokens of the run from place i on."""
        more = F.aggregate(
            F.sequence(F.lit(0), F.lit(_WORDS - 2)),
            F.struct(F.lit(1).alias("n"), F.lit(True).alias("open")),
            lambda a, k: F.when(a["open"] & joined(p, i + k * 2), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("open"))),
        )["n"]
        return F.when(
            joined(p, i),
            F.transform(F.sequence(F.lit(1), more), lambda n: F.array_join(F.slice(p, i + 1, n * 2 - 1), "")),
        ).otherwise(F.array(F.get(p, i)))

    def entry(x: Column, at: Column, p: Column, i: Column) -> Column:
        first = at + F.length(F.regexp_extract(x, edge, 0))
        # the two words before, read backwards from the token, however long they and the white space are
        back = F.reverse(F.concat(*[F.coalesce(F.get(p, i - k), F.lit("")) for k in (4, 3, 2, 1)]))
        left = F.lower(F.reverse(F.rtrim(F.regexp_replace(F.regexp_extract(back, r"^\s*+(\S++(?:\s++\S++)?+)", 1), r"\s+", " "))))

        def made(t: Column, n: Column, left: Column, kind: Column, longest: Column) -> Column:
            core = F.regexp_replace(t, edge + r"|[^A-Za-z0-9]+$", "")
            right = F.lower(F.regexp_extract(F.concat(F.get(p, i + n * 2 - 1), F.coalesce(F.get(p, i + n * 2), F.lit(""))), r"^\s*(\S+)", 1))
            out = F.struct(
                first.alias("start"),
                (first + F.length(core)).alias("end"),
                left.alias("left"),
                right.alias("right"),
                _shape(core).alias("shape"),
                F.length(F.regexp_replace(core, "[^0-9]", "")).alias("digits"),
                F.xxhash64(core).alias("value"),
                kind.alias("kind"),
                longest.alias("longest"),
            )
            return F.when(F.length(core) > 0, out)

        def kinds(near: Column, left: Column) -> Column:
            """near: base spans that end behind this token's start."""
            seed = F.filter(near, lambda b: b["start"] < at + F.length(x))
            free = lambda ts: F.filter(ts, lambda t: ~F.exists(near, lambda b: b["start"] < at + F.length(t)))
            covered = lambda ts: F.size(F.filter(ts, lambda t: at + F.length(t) < seed[0]["end"])) + 1
            plain = let(free(runs(p, i)), lambda ts: F.transform(ts, lambda t, k: made(t, k + 1, left, F.lit(-1), k + 1 == F.size(ts))))
            whole = let(
                runs(p, i),
                lambda ts: let(
                    F.least(covered(ts), F.size(ts)),
                    lambda n: F.array(made(F.element_at(ts, n), n, left, seed[0]["kind"], F.lit(True))),
                ),
            )
            return F.when(F.size(seed) == 0, plain).when(seed[0]["start"] >= first, whole)

        return let(left, lambda w: let(F.filter(base, lambda b: b["end"] > first), lambda near: kinds(near, w)))

    return F.filter(F.flatten(_walk(pieces, entry)), lambda x: x.isNotNull())


#: Sides of a pattern: two words before, word before and word after, word before, word after.
_SIDES = ("L", "B", "l", "r")


def _edges(instances: DataFrame) -> DataFrame:
    """instances with side and pattern, a row for each context that has all its words."""
    word = F.element_at(F.split("left", " "), -1)
    has_left, has_right = F.col("left") != "", F.col("right") != ""
    of = {
        "L": (has_left, F.col("left")),
        "B": (has_left & has_right, F.concat(word, F.lit(" _ "), F.col("right"))),
        "l": (has_left, word),
        "r": (has_right, F.col("right")),
    }
    made = [F.when(some, F.struct(F.lit(s).alias("side"), text.alias("pattern"))) for s, (some, text) in of.items()]
    return instances.withColumn("x", F.explode(F.array_compact(F.array(*made)))).select("*", "x.side", "x.pattern").drop("x", "left", "right")


def bootstrap(tokens: DataFrame, support: int, confidence: float, least: float = 0.5) -> DataFrame:
    """(row, start, end, kind) of tokens that are no seed, stand in trusted contexts and have a form of a kind.

    tokens: (row, start, end, left, right, shape, digits, value, kind, longest), kind -1 where no base span touches
    the instance. The graph joins instances and patterns of four sides (see _SIDES). A pattern's score is the share of
    its instances that are identifiers, each distinct value once; it counts with `support` distinct identifiers and a
    score from `least` on. An instance's score is the best of its two-word patterns', or, of those of one word, what
    both sides give together, 1 - (1 - a) (1 - b); it is found with `confidence`. Its kind is the one whose seeds have
    its form most often, with a number of digits between half of their fewest and twice their most.

    Of instances of kind -1 with one start the longest counts. Of found ones that overlap, the earlier round's is
    kept, then the first, and the longest of one start. A found instance counts from the next round on, in place of the
    longest one of its start; rounds end when one finds nothing new.
    """
    seeds = tokens.where("kind >= 0").groupBy("shape", F.col("kind").alias("to")).agg(
        F.count("*").alias("n"),
        F.min("digits").alias("low"),
        F.max("digits").alias("high"),
    )
    free = tokens.where("kind = -1").join(lookup(cut(seeds)), "shape").where("2 * digits >= low and digits <= 2 * high")
    forms = free.groupBy("row", "start", "end", "left", "right").agg(F.max_by("to", F.struct("n", -F.col("to"))).alias("to"))
    open_ = cut(_edges(forms))
    found = None
    while True:
        if found is None:
            now = tokens.where("longest")
        else:
            given = tokens.join(found.select("row", "start", F.col("end").alias("until"), F.col("kind").alias("given")), ["row", "start"], "left")
            now = given.where("case when kind < 0 and given is not null then end = until else longest end").withColumn(
                "kind",
                F.when(F.col("kind") < 0, F.coalesce("given", "kind")).otherwise(F.col("kind")),
            )
        # by value first: a hot pattern is counted in parts before its values meet
        values = _edges(now).groupBy("side", "pattern", "value").agg(F.max(F.when(F.col("kind") >= 0, 1).otherwise(0)).alias("is"))
        counts = values.groupBy("side", "pattern").agg(F.sum("is").alias("n"), F.count("*").alias("all"))
        trusted = cut(
            counts.where(
                (F.col("n") >= support) & (F.col("n") >= least * F.col("all"))
            ).select("side", "pattern", (F.col("n") / F.col("all")).alias("score"))
        )
        hit = spread_join(open_, trusted, ["side", "pattern"], F.xxhash64("row", "start"))
        of = {s: F.max(F.when(F.col("side") == s, F.col("score"))).alias(f"s{i}") for i, s in enumerate(_SIDES)}
        scored = hit.groupBy("row", "start", "end", F.col("to").alias("kind")).agg(*of.values())
        kinds = scored.where(F.greatest("s0", "s1", 1 - (1 - F.col("s2")) * (1 - F.col("s3"))) >= confidence).select("row", "start", "end", "kind")
        if found is not None:
            old = found.select(F.col("row").alias("row_"), F.col("start").alias("from_"), F.col("end").alias("to_"))
            kinds = kinds.join(old, F.col("row").eqNullSafe(F.col("row_")) & (F.col("start") < F.col("to_")) & (F.col("end") > F.col("from_")), "left_anti")
        new = cut(_apart(kinds))
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else cut(found.unionByName(new))


def _apart(spans: DataFrame) -> DataFrame:
    """Spans (row, start, end, kind) that do not overlap: from the first on, the longest of each start."""
    item = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind")))
    none = F.struct(F.lit(-1).alias("to"), F.array().cast("array<struct<start:int,end:int,kind:int>>").alias("out"))
    kept = F.aggregate(
        "all",
        none,
        lambda a, x: F.when(x["start"] >= a["to"], F.struct((-x["back"]).alias("to"), F.concat(a["out"], F.array(F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["kind"].alias("kind")))).alias("out"))).otherwise(a),
    )["out"]
    return spans.groupBy("row").agg(item.alias("all")).select("row", F.explode(kept).alias("x")).select("row", "x.*")


def personal_data(docs: DataFrame, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """(doc_id, text_key, base, more): base and found spans (start, kind, end) of every row, in code points.

    kind is a place in KINDS. base are the valid leftmost matches of each pattern by (start, kind); more are spans
    that bootstrapped contexts add and that no base span touches. Null and empty texts have none. Equal rows get the
    same spans; text_key is a hash of the text.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, "\x02")
    some = text.rlike("[0-9@]")
    none = F.array().cast(f"array<{_SPAN}>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text.alias("t"), some.alias("some"))
    marked = rows.withColumn("base", F.when(F.col("some"), F.array_sort(F.concat(*[_spans(F.col("t"), k) for k in KINDS]))).otherwise(none))
    bare = cut(
        marked.select(
            "doc_id",
            "text_key",
            "base",
            F.when(F.col("some"), _tokens(F.col("t"), F.col("base"))).alias("tokens"),
        )
    )
    row = F.struct("doc_id", "text_key").alias("row")
    tokens = bare.where("tokens is not null").select(row, F.explode("tokens").alias("x")).select("row", "x.*").distinct()
    found = bootstrap(tokens, support, confidence)
    more = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("more"))
    more = more.select(F.col("row.doc_id").alias("id_"), F.col("row.text_key").alias("key_"), "more")
    out = bare.join(more, bare["doc_id"].eqNullSafe(F.col("id_")) & (bare["text_key"] == F.col("key_")), "left")
    return out.select("doc_id", "text_key", "base", F.coalesce("more", none).alias("more"))


def personal_digest(found: DataFrame) -> DataFrame:
    """Counts and span lists of personal_data's rows; counts are of base spans, n_found counts those that contexts add."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *[count(k) for k in range(len(KINDS))],
        F.sha2(_join(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _join(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_found"),
    )
