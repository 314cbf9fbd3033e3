"""Personal data in texts: fixed patterns, and identifiers found by bootstrapped context.

Everything is DataFrame expressions. Base spans follow four patterns (email, ip, card, phone), leftmost
and non-overlapping for each kind, matches that fail their check being dropped. They are the seeds of a
bootstrap over identifier-like tokens that the patterns miss:

* An occurrence is a token that holds a digit or an @ sign, of any length, or a row of digit groups with
  single spaces between them. It has a shape (digit runs, letter runs and marks kept), a coarse form (see
  `coarse`) and contexts, case folded away: the word before, the word after, the two words before, and the
  word before with a key character (`tel:`). Pairs of these are its lexical patterns: shape with the word
  before, and form with each context; the token is an instance. So known spans speak for tokens of shapes
  that no known span has. A shape or form without a word is no pattern.
* Seeds say for each pattern how many of its distinct instances are known to be of a kind; those of other
  kinds count against it in full, those of which nothing is known by half. With the patterns' confidence the
  instances are scored, the best become known, and so on for a few rounds over the bipartite graph of
  patterns and instances.
* A context is evidence only by its lift: it must stand beside known instances several times as often as its
  rate among all words of all texts would have it there by chance. So words that are frequent everywhere, beside
  which identifiers fall at random, name nothing. The rate of several words is at most that of the rarest.
* Tokens that confident patterns name, and no base span touches, are further spans of the kind. Parts of
  a base span are no tokens.
* A context reads 40 code points before or after the token, and not beyond its neighbours among the tokens;
  a word beyond these counts as none.

Defined results: null text is empty text, without spans; equal or null ids get a row each; repeated rows have
equal spans; a token that patterns of several kinds name goes to the most confident one, then to the last kind
in the alphabet; other columns are kept by `redact` and ignored by `find`; an empty table gives no rows. Very
long texts are searched whole, in time linear in their length; tokens meet base spans by a join on stretches of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, text_or_empty, unused, with_key

KINDS = ("email", "ip", "card", "phone")
#: Rounds of the bootstrap; a pattern's least confidence and least number of distinct known instances.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 3
#: How many times as often as by chance a pattern's context must stand beside known instances.
LIFT = 4.0
#: Code points of a context, and of a stretch of text in which tokens meet base spans.
AROUND, STRETCH = 40, 64
#: What an instance of which nothing is known counts against a pattern.
UNKNOWN = 0.5
#: Confident patterns that are broadcast; more of them meet tokens by a shuffle, each dealt to so many salts.
MOST_BROADCAST, SALTS = 100_000, 32

#: The base patterns. Possessive repeats and starts bound to a run's begin or the last match's
#: end (\G) match what the plain patterns match, without backtracking over long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP_OK = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
#: A token of the bootstrap: no white space, at least one digit or @ sign; marks at its ends do not belong.
TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
#: Two or more digit groups with single spaces between them.
GROUPS = r"(?<![^\s])[^\s0-9@\p{L}]*+[0-9][0-9().-]*+(?: [+(]*+[0-9][0-9().-]*+(?![\p{L}\p{N}@]))++"
TRIM = r"^[^\p{L}\p{N}+]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backward = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backward, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


#: Matches placed one after the other; blocks of them are then moved as one, which keeps many matches linear.
BLOCK, SECTION = 64, 64 * 64


def named(what: Column, use) -> Column:
    """An expression over another one that is evaluated once: a one-element array binds it to a name."""
    return F.element_at(F.transform(F.array(what), use), 1)


def _matches(text: Column, pattern: str, worth: Column, around: int = 0) -> Column:
    """All matches as structs (at: code points before it, len, what), where the text is worth a look.

    With `around`, structs also have before and after: as many code points of the text on each side, up to the next match."""
    gaps = F.split(text, pattern, -1)
    sides = "before:string,after:string" if around else ""
    kept = ["len", "what", *(x.split(":")[0] for x in sides.split(",") if x)]
    kind = ",".join(["at:int,len:int,what:string", sides] if around else ["at:int,len:int,what:string"])

    def pair(gap: Column, what: Column) -> Column:
        return F.struct(F.length(gap).alias("gap"), F.length(what).alias("len"), what.alias("what"), *([F.substring(gap, -around, around).alias("before")] if around else []))

    # The last gap has no match after it; each later gap is what comes after a match.
    pairs = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pair)
    if around:
        after = F.transform(F.slice(gaps, F.lit(2), F.size(gaps)), lambda gap: F.substring(gap, 1, around))
        pairs = F.zip_with(pairs, after, lambda m, rest: F.struct(*(m[x].alias(x) for x in ("gap", "len", "what", "before")), rest.alias("after")))

    def at(place: Column, m: Column) -> Column:
        return F.struct(place.alias("at"), *(m[x].alias(x) for x in kept))

    def place(state: Column, m: Column) -> Column:
        return F.struct((state["end"] + m["gap"] + m["len"]).alias("end"), F.concat(state["out"], F.array(at(state["end"] + m["gap"], m))).alias("out"))

    def move(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda m: at(m["at"] + state["end"], m))
        return F.struct((state["end"] + block["end"]).alias("end"), F.concat(state["out"], F.array(moved)).alias("out"))

    none = F.expr(f"cast(array() as array<struct<{kind}>>)")
    zero = F.struct(F.lit(0).alias("end"), none.alias("out"))
    zeros = F.struct(F.lit(0).alias("end"), F.expr(f"cast(array() as array<array<struct<{kind}>>>)").alias("out"))

    def blocks(whole: Column, size: int, each) -> Column:
        last = F.greatest(F.floor((F.size(whole) - 1) / size).cast("int"), F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda b: named(F.slice(whole, b * size + 1, size), each))
        return F.aggregate(parts, zeros, move, lambda state: F.struct(state["end"].alias("end"), F.flatten(state["out"]).alias("out")))

    def placed(whole: Column) -> Column:
        # A slice costs a walk over its whole array, so blocks are cut from sections.
        return blocks(whole, SECTION, lambda section: blocks(section, BLOCK, lambda block: F.aggregate(block, zero, place)))["out"]

    return F.when(worth, named(F.filter(pairs, lambda x: x["what"].isNotNull()), placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: structs (at, rank of kind, end, kind, what), by start, then kind."""

    def length(x: Column) -> Column:
        return F.length(_digits(x["what"]))

    kept = {
        "email": _matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(_matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["what"].rlike(IP_OK)),
        "card": F.filter(F.filter(_matches(text, CARD, text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")), lambda x: length(x).between(14, 19)), lambda x: _luhn(_digits(x["what"]))),
        "phone": F.filter(_matches(text, PHONE, text.rlike(r"\+[0-9]")), lambda x: length(x).between(10, 15)),
    }

    def of_kind(kind: str) -> Column:
        return F.transform(kept[kind], lambda m: F.struct(m["at"].alias("at"), F.lit(KINDS.index(kind)).alias("rank"), (m["at"] + m["len"]).alias("end"), F.lit(kind).alias("kind"), m["what"].alias("what")))

    return F.array_sort(F.concat(*map(of_kind, KINDS)))


def token_places(text: Column) -> Column:
    """Identifier-like tokens as structs: at, len, what, before and after."""
    return F.concat(_matches(text, TOKEN, text.rlike("[0-9@]"), AROUND), _matches(text, GROUPS, text.rlike("[0-9().-] [+(]*[0-9]"), AROUND))


def _stretches(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / STRETCH), F.floor((end - 1) / STRETCH)))


def told(based: DataFrame) -> DataFrame:
    """Rows (_key, at, len, what, before, after, kind) of documents (_key, base, tokens): kind of the first base span in the token, or null.

    Tokens that a base span overlaps and does not lie in whole are left out."""
    each = based.select("_key", F.explode("tokens").alias("m")).select("_key", "m.*")
    near = based.where(F.size("base") > 0).select("_key", F.explode("tokens").alias("m")).select("_key", "m.at", "m.len").withColumn("stretch", _stretches(F.col("at"), F.col("at") + F.col("len")))
    spans = based.select("_key", F.explode("base").alias("s")).select("_key", "s").withColumn("stretch", _stretches(F.col("s.at"), F.col("s.end")))
    met = near.join(spans, ["_key", "stretch"]).where((F.col("s.at") < F.col("at") + F.col("len")) & (F.col("s.end") > F.col("at")))
    inside = (F.col("s.at") >= F.col("at")) & (F.col("s.end") <= F.col("at") + F.col("len"))
    met = met.groupBy("_key", "at", "len").agg(F.min(inside).alias("_whole"), F.min_by("s.kind", F.struct("s.at", "s.rank")).alias("kind"))
    return each.join(met, ["_key", "at", "len"], "left").where(F.coalesce("_whole", F.lit(True))).drop("_whole")


def coarse(shape: Column, token: Column) -> Column:
    """The form of a shape: @ where it has that sign, # for digit groups with marks or spaces between them or seven digits and more, else the shape."""
    digits = shape.rlike(r"^\+?\(?9(?:[^\p{L}\p{N}@]++9)++$") | (shape.rlike(r"^\+?9$") & (F.length(token) >= 7))
    return F.when(shape.rlike("[a9]@+[a9]"), F.lit("@")).when(digits, F.lit("#")).otherwise(shape)


def occurrences(each: DataFrame) -> DataFrame:
    """Rows of `told` as _key, at, end, token, patterns (shape, context), kind."""
    # The bare token: marks at its ends cut off, its place moved accordingly.
    lead = F.length(F.regexp_extract("what", r"^[^\p{L}\p{N}+]*+", 0))
    bare = each.select("_key", "before", "after", "kind", (F.col("at") + lead).alias("at"), F.regexp_replace("what", TRIM, "").alias("token"))
    bare = bare.where(F.length("token") > 0).withColumn("end", F.col("at") + F.length("token"))
    shape = F.regexp_replace(F.regexp_replace("token", r"\p{N}+", "9"), r"\p{L}+", "a")
    before, after = F.lower("before"), F.lower("after")
    left, right = F.regexp_extract(before, r"(\p{L}+)[^\p{L}\p{N}]*$", 1), F.regexp_extract(after, r"^[^\p{L}\p{N}]*(\p{L}+)", 1)
    two = F.regexp_replace(F.regexp_extract(before, r"(\p{L}+[^\p{L}\p{N}]+\p{L}+)[^\p{L}\p{N}]*$", 1), r"[^\p{L}]+", " ")
    key = F.regexp_replace(F.regexp_extract(before, r"(\p{L}+\s*[:=#])[^\p{L}\p{N}]*$", 1), r"\s+", "")
    bare = bare.select("_key", "at", "end", "token", "kind", shape.alias("shape"), left.alias("left"), right.alias("right"), two.alias("two"), key.alias("key"))

    def pattern(kind: str, what: Column, words: str) -> Column:
        return F.struct(F.concat(F.lit(kind), what).alias("shape"), F.col(words).alias("context"))

    form = coarse(F.col("shape"), F.col("token"))
    sides = F.array(*(pattern(kind, form, words) for kind, words in (("<", "left"), (">", "right"), ("2", "two"), (":", "key"))))
    patterns = F.concat(F.array(pattern("=", F.col("shape"), "left")), F.when(form.isin("@", "#"), sides).otherwise(F.slice(sides, 1, 0)))
    return bare.select("_key", "at", "end", "token", F.filter(patterns, lambda p: p["context"] != "").alias("patterns"), "kind")


def context_rates(graph: DataFrame, texts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Rows (context, rate) of contexts with enough instances: the least share of one of its words among all words of all texts."""
    contexts = graph.groupBy("shape", "context").count().where(F.col("count") >= support).select("context").distinct()
    words = contexts.select("context", F.explode(F.split(F.regexp_replace("context", "[:=#]$", ""), " ")).alias("word"))
    # Counts combine before the shuffle; contexts are joined to words, not to their occurrences.
    counts = cut(texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.col("word") != "").groupBy("word").count())
    total = counts.agg(F.sum("count")).first()[0] or 1
    return words.join(counts, "word", "left").groupBy("context").agg((F.min(F.coalesce("count", F.lit(0))) / F.lit(total)).alias("rate"))


def bootstrap(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, lift: float = LIFT) -> DataFrame:
    """Confident patterns over occurrences in texts: shape, context, kind, confidence."""
    graph = cut(found.select("token", "kind", F.explode("patterns").alias("p")).select("token", "kind", "p.*").groupBy("shape", "context", "token").agg(F.max("kind").alias("kind")))
    rates = cut(context_rates(graph, texts, support))
    known = graph.where(F.col("kind").isNotNull()).select("token", "kind", F.lit(1.0).alias("score")).distinct()
    patterns = None
    for step in range(rounds):
        # A pattern's confidence: mass of the kind among its distinct instances, with one doubtful instance added.
        marked = graph.select("shape", "context", "token").join(known.groupBy("token").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")), "token", "left")
        mass = marked.groupBy("shape", "context", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n"))
        weight = F.when(F.col("kind").isNull(), UNKNOWN).otherwise(1.0)
        total = marked.groupBy("shape", "context").agg(F.sum(weight).alias("all"))
        of_kind = mass.where(F.col("kind").isNotNull())
        # What chance would put beside a context: its rate times the kind's instances of the shape, and one more.
        drawn = of_kind.groupBy("shape", "kind").agg(F.sum("n").alias("drawn"))
        patterns = of_kind.join(total, ["shape", "context"]).where((F.col("n") >= support) & (F.col("mass") / (F.col("all") + 1) >= confidence))
        patterns = patterns.join(drawn, ["shape", "kind"]).join(rates, "context").where(F.col("n") >= lift * (1 + F.col("drawn") * F.col("rate")))
        patterns = cut(patterns.select("shape", "context", "kind", "n", (F.col("mass") / (F.col("all") + 1)).alias("confidence")))
        if step == rounds - 1 or not patterns.take(1):
            break
        # An instance's score: the chance that not all patterns that name it are wrong.
        named = graph.join(patterns.select("shape", "context", F.col("kind").alias("as"), "confidence"), ["shape", "context"])
        scored = named.groupBy("token", F.col("as").alias("kind")).agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        seeds = graph.where(F.col("kind").isNotNull()).select("token", "kind", F.lit(1.0).alias("score")).distinct()
        known = cut(seeds.union(scored.where(F.col("score") >= confidence)).groupBy("token", "kind").agg(F.max("score").alias("score")))
    return patterns


def _named(new: DataFrame, chosen: DataFrame, most_broadcast: int) -> DataFrame:
    """Tokens (shape, context, ...) with the best kind of their patterns. One pattern may have a third of all tokens."""
    chosen = cut(chosen)
    if chosen.count() <= most_broadcast:
        return new.join(F.broadcast(chosen), ["shape", "context"])
    salted = new.withColumn("salt", F.pmod(F.xxhash64("_key", "at"), F.lit(SALTS)).cast("int"))
    dealt = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(dealt.hint("merge"), ["shape", "context", "salt"]).drop("salt")


def spans_of(keyed: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """For documents (_key, doc_id, text): _key, doc_id, base and spans (base ones and discovered ones, by start, then kind)."""
    prepare(keyed.sparkSession)
    texts = keyed.select("_key", "doc_id", text_or_empty().alias("text"))
    based = texts.withColumn("base", base_spans(F.col("text")))
    based = cut(based.select("_key", "doc_id", "base", token_places(F.col("text")).alias("tokens")))
    found = cut(occurrences(told(based)))
    patterns = bootstrap(found, texts)
    chosen = patterns.groupBy("shape", "context").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    new = found.where(F.col("kind").isNull()).select("_key", "at", "end", "token", F.explode("patterns").alias("p")).select("_key", "at", "end", "token", "p.*")
    new = _named(new, chosen, most_broadcast)
    new = new.groupBy("_key", "at", "end", "token").agg(F.max("best")["kind"].alias("as"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("as")).cast("int") - 1
    new = new.groupBy("_key").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), rank.alias("rank"), F.col("end").cast("int").alias("end"), F.col("as").alias("kind"), F.col("token").alias("what"))).alias("_new"))
    none = F.expr("cast(array() as array<struct<at:int,rank:int,end:int,kind:string,what:string>>)")
    joined = based.join(new, "_key", "left")
    return joined.select("_key", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("_new", none))).alias("spans"))


def find(docs: DataFrame) -> DataFrame:
    """For documents (doc_id, text): doc_id, base, spans."""
    return spans_of(with_key(docs.select("doc_id", "text"))).drop("_key")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def hidden(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, of the first kind.

    Each block of spans takes its stretch of the text once, so that many spans do not walk the text as often."""
    strings = F.expr("cast(array() as array<string>)")

    def put(part: Column, start: Column):
        def one(state: Column, s: Column) -> Column:
            gap = F.substring(part, state["end"] - start + 1, F.greatest(s["at"] - state["end"], F.lit(0)))
            mark = F.when(s["at"] >= state["end"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
            return F.struct(F.greatest(state["end"], s["end"]).alias("end"), F.concat(state["out"], F.array(mark)).alias("out"))

        return one

    def block(state: Column, b: Column) -> Column:
        some = F.slice(spans, b * 16 * BLOCK + 1, 16 * BLOCK)
        part = F.substring(text, state["end"] + 1, F.greatest(F.array_max(F.transform(some, lambda s: s["end"])) - state["end"], F.lit(0)))
        start = F.struct(state["end"].alias("end"), strings.alias("out"))
        done = named(part, lambda p: F.aggregate(some, start, put(p, state["end"]), lambda x: F.struct(x["end"].alias("end"), F.array_join(x["out"], "").alias("out"))))
        return named(done, lambda d: F.struct(d["end"].alias("end"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    blocks = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / (16 * BLOCK)).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    start = F.struct(F.lit(0).alias("end"), strings.alias("out"))
    return F.aggregate(blocks, start, block, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["end"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with their spans hidden, and n_chars, if there, counted anew. Null texts stay null."""
    key, spans = unused(docs, "_key"), unused(docs, "_spans")
    keyed = with_key(docs, key)
    found = spans_of(keyed.select(F.col(key).alias("_key"), "doc_id", "text")).where(F.size("spans") > 0)
    found = keyed.join(found.select(F.col("_key").alias(key), F.col("spans").alias(spans)), key, "left")
    new = F.when(F.col(spans).isNotNull(), hidden(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    found = found.withColumn("text", new)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*docs.columns)
