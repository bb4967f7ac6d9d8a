"""Personal data by patterns and by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers, and, as a kind of its own, long hexadecimal
secrets. They are seeds. All identifier-like tokens of the corpus (with a digit, an @ or an (at)) are candidates. What
stands around a seed or candidate is generalised to lexical patterns: the two words before it, or one, with the marks
after them; the word before and the word behind; the word before, or behind, with the shape of the token; and the shape
of the token between the kinds of its neighbours. Over the graph of patterns and instances confidence goes back and
forth until no pattern changes: a pattern has the share of its instances that are trusted, an instance the noisy-or of
its patterns. A pattern without a word has the share of seeds only, as it would drift. Patterns of high confidence and
enough instances then name the candidates that they match.

Texts are searched once; finds, candidates and their patterns are written narrow, and all else reads those.

The expressions below are the contract's in forms that take linear time and no recursion in Java: quantified groups
are possessive, and a match may start only where a run of its first characters does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgauge.llm.common import cut, filled, others, written
from txgauge.session import small

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: kind: (which texts to look at, expression)
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Seeds of a kind that the contract does not count: 32 to 128 hexadecimal digits, of them a letter and a digit.
SECRET = r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,128}+(?![A-Za-z0-9])"
_OUT = r"\s,;\"'<>\[\]="
#: A run of other characters than these, from its first letter, digit, + or ( to its last letter or digit.
CANDIDATE = rf"(?<![^{_OUT}])(?=[^{_OUT}@(0-9]*(?:[0-9@]|\([^{_OUT}@(0-9]*[0-9@]|\(at\)))[\p{{L}}0-9+(][^{_OUT}]+(?<=[\p{{L}}0-9])"
#: Characters on either side from which neighbouring words are taken; of a longer word its part within them.
REACH = 64
_BLOCK = 512
ADDED = (*KINDS, "secret", "added")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column) -> Column:
    """Sums of what stands before each element, in blocks, as growing an array costs its length each time."""

    def sums(a: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("p"))
        return F.aggregate(a, zero, lambda z, x: F.struct((z["s"] + x).alias("s"), F.concat(z["p"], F.array(z["s"])).alias("p")))

    def blocks(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(_BLOCK)), lambda o: sums(F.slice(a, o + 1, _BLOCK)))

    def shifted(b: Column, offsets: Column) -> Column:
        return F.flatten(F.transform(b, lambda x, i: _let(F.get(offsets, i), lambda o: F.transform(x["p"], lambda y: y + o))))

    return _let(blocks(sizes), lambda b: _let(sums(F.transform(b, lambda x: x["s"]))["p"], lambda o: shifted(b, o)))


def _found(text: Column, pattern: str) -> Column:
    """Matches as structs: start and end in code points, s, and left and right, REACH characters of what stands around it."""

    def spans(m: Column) -> Column:
        sizes = F.zip_with(F.slice(m["g"], 1, F.size(m["s"])), m["s"], lambda g, s: (F.length(g) + F.length(s)).cast("long"))

        def one(s: Column, i: Column, at: Column) -> Column:
            gap, behind = F.get(m["g"], i), F.get(m["g"], i + 1)
            start = F.get(at, i) + F.length(gap)
            before = F.concat(F.coalesce(F.get(m["g"], i - 1), F.lit("")), F.coalesce(F.get(m["s"], i - 1), F.lit("")), gap)
            after = F.concat(behind, F.coalesce(F.get(m["s"], i + 1), F.lit("")), F.coalesce(F.get(m["g"], i + 2), F.lit("")))
            near = lambda x, short, place: F.substring(F.when(F.length(short) >= REACH, short).otherwise(x), place, REACH)
            return F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s"), near(before, gap, -REACH).alias("left"), near(after, behind, 1).alias("right"))

        return _let(_running(sizes), lambda at: F.transform(m["s"], lambda s, i: one(s, i, at)))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"), F.split(text, pattern, -1).alias("g")), spans)


_SPANS = "array<struct<start: long, end: long, s: string, left: string, right: string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    def valid(d: Column) -> Column:
        worth = lambda i: F.substring(d, i, 1).cast("int")
        twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda z, i: z + F.when(i % 2 == 0, twice(worth(i))).otherwise(worth(i)))
        return total % 10 == 0

    return _let(F.reverse(_digits(s)), valid)


def base_spans(text: Column, kind: str) -> Column:
    """Valid finds of one kind, in order."""
    holds, pattern = PATTERNS[kind]
    test = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["s"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda x: _luhn(x["s"]),
        "phone": lambda x: F.length(_digits(x["s"])).between(8, 15),
    }[kind]
    found = _found(text, pattern) if kind == "email" else F.filter(_found(text, pattern), test)
    seen = F.contains(text, F.lit(holds)) if holds == "@" else text.rlike(holds)
    return F.when(seen, found.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _secrets(text: Column) -> Column:
    return F.when(text.rlike("[0-9A-Fa-f]{32}"), _found(text, SECRET).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens that overlap no seed."""
    free = _let(base, lambda all_: F.filter(_found(text, CANDIDATE), lambda c: ~F.exists(all_, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))))
    return F.when(text.rlike(r"[0-9@]|\(at\)"), free.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def shape(token: Column) -> Column:
    """9 for each digit, a for each run of letters, all else as it is; hex for long mixed hexadecimal; a hash of what is long."""
    s = F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), r"\p{L}+", "a")
    mixed = token.rlike("^[0-9A-Fa-f]{16,}$") & token.rlike("[0-9]") & token.rlike("[A-Fa-f]")
    return F.when(mixed, "hex").when(F.length(s) > 48, F.concat(F.lit("#"), F.hex(F.xxhash64(s)))).otherwise(s)


def _kind_of_word(word: Column) -> Column:
    """Of a neighbour: none, a word, a word with a mark at its end, a number, or something else."""
    return F.when(word == "", "-").when(word.rlike(r"^\p{L}+$"), "a").when(word.rlike(r"^\p{L}+\p{P}+$"), "a.").when(word.rlike("^[0-9.,]+$"), "9").otherwise("?")


def patterns_of(find: Column) -> Column:
    """The patterns around one find, as strings that begin with what they are; those without a word to go by are left out."""

    def made(w: Column) -> Column:
        before, one, after, form = w["before"], w["one"], w["after"], w["form"]
        every = F.array(
            F.when(before != "", F.concat_ws(" ", F.lit("2"), before, one)),
            F.when(one != "", F.concat(F.lit("1 "), one)),
            F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("lr"), one, F.lit("_"), after)),
            F.when(one != "", F.concat_ws(" ", F.lit("l"), one, F.lit("_"), form)),
            F.when(after != "", F.concat_ws(" ", F.lit("r"), form, F.lit("_"), after)),
            F.concat_ws(" ", F.lit("s"), _kind_of_word(one), form, _kind_of_word(after)),
        )
        return F.filter(every, lambda x: x.isNotNull())

    left = F.regexp_extract_all(F.lower(find["left"]), F.lit(r"\S*[\p{L}\p{N}][^\p{L}\p{N}]*+"), F.lit(0))
    right = F.regexp_extract(F.lower(find["right"]), r"^\s*(\S+)", 1)

    def words(w: Column) -> Column:
        last = F.trim(F.coalesce(F.get(w, F.size(w) - 1), F.lit("")))
        before = F.trim(F.coalesce(F.get(w, F.size(w) - 2), F.lit("")))
        return _let(F.struct(before.alias("before"), last.alias("one"), right.alias("after"), shape(find["s"]).alias("form")), made)

    return _let(left, words)


_NODES = "array<struct<kind: string, start: long, end: long, s: string, patterns: array<string>>>"


def _nodes(finds: Column, kind: str | None) -> Column:
    return F.transform(finds, lambda x: F.struct(F.lit(kind).cast("string").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), patterns_of(x).alias("patterns"))).cast(_NODES)


def searched(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns in keep, __row (a number of the row's own) and __nodes: all seeds (with kind) and candidates (kind null), in a written table."""
    columns = list(docs.columns if keep is None else keep)
    d = docs.withColumn("__text", filled(F.col(text_col)))
    d = d.withColumns({f"__{k}": base_spans(F.col("__text"), k) for k in KINDS}).withColumn("__secret", _secrets(F.col("__text")))
    seeds = (*KINDS, "secret")
    every = F.concat(*[F.transform(f"__{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in seeds])
    nodes = F.concat(*[_nodes(F.col(f"__{k}"), k) for k in seeds], _nodes(_candidates(F.col("__text"), every), None))
    return written(d.select(*columns, nodes.alias("__nodes"), F.monotonically_increasing_id().alias("__row")), "pii")


def pattern_graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, kind, n): kind null for candidates, n the pattern's instances."""
    e = found.select(F.explode("__nodes").alias("e")).select(F.explode("e.patterns").alias("pattern"), F.col("e.s").alias("instance"), "e.kind")
    e = e.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    sizes = e.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return e.join(sizes, "pattern")


def learn_patterns(graph: DataFrame, rounds: int = 8, least_support: int = 3, least_confidence: float = 0.8) -> DataFrame:
    """(pattern, kind, confidence) of the patterns to be trusted; at most `rounds` rounds, fewer if nothing changes."""
    graph = cut(graph)
    graph, every = graph.filter(F.col("n") >= least_support), graph
    seeds = every.filter("kind is not null").select("instance", "kind").distinct().select("*", F.lit(1.0).alias("trust"), F.lit(1.0).alias("seed"))
    trusted, last = seeds, None
    while True:
        trust = F.when(F.col("pattern").startswith("s "), F.col("seed")).otherwise(F.col("trust"))
        scored = graph.drop("kind").join(trusted, "instance").groupBy("pattern", "n", "kind").agg(F.sum(trust).alias("s"), F.count(F.lit(1)).alias("support"))
        good = scored.withColumn("confidence", F.col("s") / F.col("n")).filter((F.col("support") >= least_support) & (F.col("confidence") >= least_confidence))
        best = good.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        patterns = cut(best.select("pattern", "b.kind", "b.confidence"))
        rounds, state = rounds - 1, tuple(patterns.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(pattern, kind, round(confidence, 6)))")).first())
        if state == last or rounds <= 0:
            return patterns
        last = state
        drawn = graph.drop("kind").join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("trust"), F.lit(0.0).alias("seed"))
        trusted = seeds.union(drawn).groupBy("instance", "kind").agg(F.max("trust").alias("trust"), F.max("seed").alias("seed"))


def find(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, **how) -> DataFrame:
    """The columns of docs in keep (by default all) with one for each kind and secret (start, end, s) and added (kind, start, end).

    Null text counts as empty and has no finds. Repeated rows have the same finds each. Added finds overlap no seed,
    and of several kinds have that of the pattern of most confidence. Input columns named like an added one, in any
    case, are replaced; an empty table gives an empty result. `how` goes to learn_patterns.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c in others(docs, ADDED)]
    found = searched(docs, text_col, columns)
    patterns = learn_patterns(pattern_graph(found), **how)
    n = patterns.count()
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    if n:
        free = found.select("__row", F.explode(F.filter("__nodes", lambda x: x["kind"].isNull())).alias("c")).select("__row", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
        named = free.join(small(patterns, n), "pattern").groupBy("__row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        named = cut(named.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("b.kind", "start", "end"))).alias("__added")))
        found = found.join(small(named, named.count()), "__row", "left")
    else:
        found = found.withColumn("__added", none)
    spans = lambda k: F.transform(F.filter("__nodes", lambda x: x["kind"] == k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))
    return found.select(*columns, *[spans(k).alias(k) for k in (*KINDS, "secret")], F.coalesce("__added", none).alias("added"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the hash of the base finds, all finds as kind:start:end, and the same of secrets, which are no base kind."""

    def said(kind: str, x: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))

    def all_said(k: str, finds: Column) -> Column:
        return F.transform(finds, lambda x: said(k, x))

    base = F.concat(*[all_said(k, F.col(k)) for k in KINDS])

    def both(k: str) -> Column:
        own = F.transform(F.col(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        more = F.transform(F.filter("added", lambda x: x["kind"] == k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        return F.array_sort(F.concat(own, more))

    return found.select(
        id_col,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[all_said(k, both(k)) for k in KINDS]), ",").alias("spans"),
        F.size(both("secret")).cast("long").alias("n_secret"),
        F.array_join(all_said("secret", both("secret")), ",").alias("secret_spans"),
        F.size("added").cast("long").alias("n_added"),
    )
