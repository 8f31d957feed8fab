"""Personal data: patterns, and terms that give protected entities away.

Patterns find the protected entities (mail and IP addresses, card and phone numbers). How strongly a term reveals an
entity is the pointwise mutual information of the two over the corpus, against the entity's own information
content. Both are counted over whole documents. A term that stands in at least ``min_joint`` documents of an entity, outside the entity's
own value, and whose share reaches ``disclosure``, is generalised wherever it stands in a document with that entity. Everything is a DataFrame expression; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import only, settle, settle_table

#: Possessive forms of the base patterns: they match the same strings in linear time and stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A match is a whole run of digits with single separators, so only runs of 13 to 19 digits need to be looked at.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"\p{L}{3,}+"
KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind: string, start: int, end: int>>"
VALUED = "array<struct<kind: string, start: int, end: int, value: string>>"
#: Pieces whose lengths are summed together on the way to a match's place.
RUN = 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def located(text: Column, pattern: Column, kind: str, valid: Callable[[Column], Column]) -> Column:
    """Valid matches as (kind, start, end, value) in code points.

    Matches and the pieces between them have the same order, so a match starts after the lengths of all before it. These are summed in
    runs of RUN, so the work grows with the number of matches and not with its square.
    """
    lengths = lambda values: F.transform(values, lambda p: F.char_length(p))

    def spans(found: Column) -> Column:
        steps = F.zip_with(lengths(F.split(text, pattern, -1)), F.concat(F.array(F.lit(0)), lengths(found)), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        return bound(steps, lambda s: bound(runs(s), lambda r: each(found, s, r)))

    def runs(steps: Column) -> Column:
        """Sums of the runs of steps, then of all runs before each."""
        per_run = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda b: _total(F.slice(steps, b * RUN + 1, F.lit(RUN))))
        return bound(per_run, lambda p: F.transform(p, lambda _, b: _total(F.slice(p, F.lit(1), b))))

    def each(found: Column, steps: Column, before: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            run = F.floor(i / RUN).cast("int")
            start = (F.get(before, run) + _total(F.slice(steps, run * RUN + 1, i - run * RUN + 1))).cast("int")
            return bound(start, lambda at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.char_length(m)).cast("int").alias("end"), m.alias("value")))

        # places first for those that hold, so that no place of others is worked out
        kept = F.filter(F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: valid(x["m"]))
        return F.transform(kept, lambda x: span(x["m"], x["i"]))

    return bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(F.array().cast(VALUED)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_valid(value: Column) -> Column:
    number = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(value, r"\."), lambda p: (F.char_length(number(p)) <= 3) & (F.coalesce(number(p).try_cast("int"), F.lit(0)) <= 255))


def _luhn(value: Column) -> Column:
    def holds(d: Column) -> Column:
        n = F.char_length(d)

        def weighed(i: Column) -> Column:
            return bound(F.substring(d, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))

        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weighed(i))
        return F.when((n >= 13) & (n <= 19), total % 10 == 0).otherwise(False)

    return bound(_digits(value), holds)


def _phone_valid(value: Column) -> Column:
    return F.char_length(_digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>>, by kind as listed, then start."""
    none = F.array().cast(VALUED)
    digits = F.rlike(text, F.lit("[0-9]"))
    per_kind = [
        F.when(F.contains(text, F.lit("@")), located(text, F.lit(EMAIL), "email", lambda v: F.lit(True))).otherwise(none),
        F.when(digits & F.rlike(text, F.lit(r"[0-9]\.[0-9]")), located(text, F.lit(IP), "ip", _ip_valid)).otherwise(none),
        F.when(digits, located(text, F.lit(CARD), "card", _luhn)).otherwise(none),
        F.when(F.contains(text, F.lit("+")) & digits, located(text, F.lit(PHONE), "phone", _phone_valid)).otherwise(none),
    ]
    return F.concat(*per_kind)


def _entity(span: Column) -> Column:
    """An entity is the same however its value is written."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _terms(text: Column) -> Column:
    """Distinct words of three letters or more, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def _outside(text: Column, spans: Column) -> Column:
    """The pieces of the text between spans, each apart from the next."""
    edges = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def pieces(ordered: Column) -> Column:
        # spans of two kinds may overlap: a piece between such starts and ends holds letters of a value only where both end
        starts = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda s: s["end"]))
        ends = F.concat(F.transform(ordered, lambda s: s["start"]), F.array(F.char_length(text)))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(b > a, F.substring(text, a + 1, b - a)).otherwise("")), " ")

    return bound(edges, pieces)


def disclosing_terms(found: DataFrame, texts: DataFrame, n_docs: int, disclosure: float, min_joint: int) -> DataFrame:
    """(entity, term) whose mutual information reaches ``disclosure`` of the entity's information.

    ``found`` has (entities, words, own) of the rows with entities: distinct entities of each row, its terms outside their values, and the terms
    of each value by entity; ``texts`` has the text of every row, ``n_docs`` their number.
    """
    of_entity = settle(found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")))
    # a pair is in no more documents than its entity
    rows = found.select("words", "own", F.explode("entities").alias("entity")).join(of_entity.where(F.col("n_entity") >= min_joint), "entity")
    others = F.flatten(F.transform(F.filter("own", lambda o: o["entity"] != F.col("entity")), lambda o: o["terms"]))
    pairs = rows.select("entity", F.explode(F.array_union("words", others)).alias("term"))
    joint = settle(pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_joint")).where(F.col("n_joint") >= min_joint))
    # counted per task before the shuffle, so each task sends a word once
    of_term = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    x = joint.join(of_entity, "entity").join(of_term, "term")
    total = F.lit(float(max(1, n_docs)))
    information = F.log2(total / F.col("n_entity"))
    mutual = F.log2(F.col("n_joint") * total / (F.col("n_entity").cast("double") * F.col("n_term")))
    return x.where((information > 0) & (mutual >= F.lit(disclosure) * information)).select("entity", "term")


def find_personal_data(docs: DataFrame, text: str = "text", disclosure: float = 0.8, min_joint: int = 3) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end) in code points, ends exclusive.

    ``base`` are the pattern spans; ``spans`` adds spans of kind ``term``, in order of their start. Null texts are empty. Repeated rows repeat
    and count each as a document; equal shares all count. Very long texts take time in proportion to their length and matches. An empty table gives
    no rows; columns named like an output are replaced.
    """
    kept = docs.drop(*[c for c in ("base", "spans") if c != text])
    columns = [F.col(c).alias(f"__c{i}") for i, c in enumerate(kept.columns) if c not in ("base", "spans")]
    named = [F.col(f"__c{i}").alias(c) for i, c in enumerate(kept.columns) if c not in ("base", "spans")]
    rows = kept.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__found", base_spans(F.col("__text")))
    found = F.col("__found")
    plain = F.transform(found, lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(SPAN)
    # only rows with an entity go on with their text; a row's number holds because the table is written once
    hits = settle_table(rows.where(F.size(found) > 0).withColumn("__row", F.monotonically_increasing_id()))
    own = F.transform(found, lambda s: F.struct(_entity(s).alias("entity"), _terms(s["value"]).alias("terms")))
    held = settle_table(hits.select("__row", F.array_distinct(F.transform(found, _entity)).alias("entities"), _terms(_outside(F.col("__text"), found)).alias("words"), own.alias("own")))
    told = settle(disclosing_terms(held, docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), docs.count(), disclosure, min_joint))
    # (row, term) and the words of such rows, met by both
    wanted = settle(held.select("__row", F.explode("entities").alias("entity")).join(told, "entity").select("__row", "term").distinct())
    words = only(hits.select("__row", "__text"), wanted.select("__row"), "__row")
    words = words.select("__row", F.explode(located(F.col("__text"), F.lit(WORD), "term", lambda v: F.lit(True))).alias("w"))
    terms = words.withColumn("term", F.lower("w.value")).join(wanted, ["__row", "term"]).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("w.kind", "w.start", "w.end"))).cast(SPAN).alias("__more"))
    none = F.array().cast(SPAN)
    with_terms = hits.join(terms, "__row", "left").withColumn("base", plain).withColumn("spans", F.concat("base", F.coalesce("__more", none)))
    others = rows.where(F.size(found) == 0).withColumn("base", none).withColumn("spans", none)
    return with_terms.select(*named, "base", "spans").unionByName(others.select(*named, "base", "spans"))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, longest one counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= a["at"], F.struct((-s["end"]).alias("at"), piece.alias("out"))).otherwise(a)

    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed (terms last), then start."""
    order = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
