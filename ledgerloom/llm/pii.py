r"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

*Patterns.* E-mail and IP addresses, card and phone numbers, leftmost and non-overlapping per kind. The
expressions below match the same places as the plain ones, but never go back over characters, so they take
linear time on any text.

*Terms.* A protected entity is the value of a pattern's match; terms are the words of ``LEAST_LETTERS`` letters or more outside
of matches. Over the whole corpus, ``n_e`` rows hold the entity, ``n_t`` the term and ``n_et`` both, wherever they stand
in the text. A term's disclosure of the entity is ``PMI(entity; term) / IC(entity)`` with ``IC = ln(N / n_e)`` and
``PMI = ln(P * N / n_e)``, where P, the chance of the entity where the term is, is taken at the lower end of its confidence
interval (Wilson's score, ``DEVIATIONS`` standard deviations), not at ``n_et / n_t``: few rows prove little. It is near
1 if the term never stands without the entity and both do so often, and 0 or less if it says nothing. A term is generalised
from ``GENERALISE_FROM`` on and removed from ``REMOVE_FROM`` on, at every place in each text that holds the entity.

A single joint row is no evidence by itself, as every rare word of that row has it. It counts only for a term that stands there
like a name: with a capital within a sentence. And what would come about by chance (both independent) with a
probability above ``CHANCE`` tells nothing, however often it does.

All of it is DataFrame expressions. Texts are read twice (patterns, term counts) and not shuffled for finding; those with
a match are kept with their spans. Entities that stand in exactly the same rows have the same statistics and are one
class, so a page that lists thousands of addresses found nowhere else counts as one entity; of a class in one row only
the name-like terms are paired at all. Pairs are summed up within tasks before their shuffle. They are looked up with class
and term, so an entity of many texts brings no text a term it lacks. Only the sanitised texts need one join with their spans.

Defined results: a null or empty text has no spans; a row is known by its id and text, so rows repeated under
one id get spans of their own text; a null id is an id like others; very long texts are read whole; an
empty table gives no rows. Finding reads ``doc_id`` and ``text`` only; sanitising keeps every column and changes
``text`` and, if there is one, ``n_chars``. A null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of
from ledgerloom.session import cut

#: Fixed kinds, in the order that results list them.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

_BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_NAME = "A-Za-z0-9._%+-"
#: What is looked for. An address begins where no address character stands before it, or where the last match ended.
_PATTERNS = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}

LEAST_LETTERS = 3
CHANCE = 0.1
DEVIATIONS = 1.0
GENERALISE_FROM, REMOVE_FROM = 0.7, 0.9
_LETTERS = r"\p{L}+"
#: Words are found in pieces of so many, as a list of places takes quadratic time to grow.
_PIECE = r"(?:\P{L}*+\p{L}++){1,64}+"
#: A word with a capital behind another word or number, so not where a sentence begins.
_NAMES = r"(?<=[\p{Ll}\p{N},;] {1,8})\p{Lu}\p{L}++"
#: What a class of entities is known by: in how many rows it is, and two sums over those rows.
_CLASS = ["n_e", "_rows1", "_rows2"]
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_FOUND = "array<struct<found:string,start:bigint,end:bigint>>"


def _places(text: Column, pattern: str) -> Column:
    """(found, start, end) of every match, in code points; from the matches and what lies between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_FOUND).alias("places"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        place = F.struct(pair["hit"].alias("found"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["places"], F.array(place)).alias("places"))

    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, begin, add, lambda acc: acc["places"])).otherwise(F.array().cast(_FOUND))


def _luhn(digits: Column) -> Column:
    ordered = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))

    def weighed(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(ordered, weighed), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(found, "[ -]", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _kept(kind: str, text: Column) -> Column:
    """The valid matches of a kind."""
    kept = F.filter(_places(text, _PATTERNS[kind]), lambda p: _valid(kind, p["found"]))
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), kept).otherwise(F.array().cast(_FOUND)) if kind in _NEEDS else kept


def _merged(spans: Column) -> Column:
    """Spans (kind, start, end) by start, overlapping ones as one of the first's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        over = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))
        return F.when(F.size(acc) == 0, F.array(s)).when(last["end"] > s["start"], over).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, begin, add)


def _row_key() -> Column:
    return F.xxhash64("doc_id", text_of())


def _words(text: Column) -> Column:
    """(found, start, end) of every word."""

    def within(piece: Column) -> Column:
        return F.transform(
            _places(piece["found"], _LETTERS),
            lambda w: F.struct(w["found"].alias("found"), (w["start"] + piece["start"]).alias("start"), (w["end"] + piece["start"]).alias("end")),
        )

    return F.flatten(F.transform(_places(text, _PIECE), within))


def _terms(text: Column, spans: Column) -> Column:
    """The terms outside of merged spans, with their places: (term, start, end)."""

    def between(i: Column) -> Column:
        start = F.when(i > 0, F.element_at(spans, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
        end = F.when(i < F.size(spans), F.element_at(spans, F.least(i + 1, F.size(spans)))["start"]).otherwise(F.length(text))
        return F.transform(
            _words(F.substring(text, start + 1, end - start)),
            lambda w: F.struct(F.lower(w["found"]).alias("term"), (w["start"] + start).alias("start"), (w["end"] + start).alias("end")),
        )

    places = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), between))
    return F.filter(places, lambda w: F.length(w["term"]) >= LEAST_LETTERS)


def _whole_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_LETTERS), F.lit(0)), F.lower))


def _based(docs: DataFrame) -> DataFrame:
    """doc_id, key, base spans in listed order, and text and merged spans of rows that have any, kept on shared storage."""
    rows = docs.select("doc_id", _row_key().alias("_key"), text_of().alias("_text"))
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", _kept(kind, F.col("_text")))
    spans = F.concat(*map(_as_spans, KINDS))
    rows = rows.select("doc_id", "_key", "_text", spans.cast(_SPAN).alias("base"))
    held = F.size("base") > 0
    return cut(rows.select("doc_id", "_key", "base", F.when(held, F.col("_text")).alias("_text"), F.when(held, _merged(F.col("base"))).alias("_merged")))


def _as_spans(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))


def _log_chance(total: int) -> Column:
    """The lower of two upper bounds (Markov, Chernoff) of the chance of ``n_et`` joint documents, as a logarithm."""
    ratio = F.col("n_e") * F.col("n_t") / (F.col("n_et") * F.lit(float(total)))
    tail = F.when(ratio < 1, F.col("n_et") * (1 - ratio + F.log(ratio))).otherwise(F.lit(0.0))
    return F.least(F.log(ratio), tail)


def _entities() -> Column:
    """The distinct entities (kind, value) of a row."""
    value = lambda s: F.lower(F.substring(F.col("_text"), s["start"] + 1, s["end"] - s["start"]))
    return F.array_distinct(F.transform("_merged", lambda s: F.struct(s["kind"].alias("kind"), value(s).alias("value"))))


def _classes(held: DataFrame) -> DataFrame:
    """_key and class of the entities of each row. Entities that stand in the same rows are one class."""
    each = held.select("_key", F.explode(_entities()).alias("e")).select("_key", "e.kind", "e.value")
    number = lambda *parts: F.sum(F.xxhash64("_key", *parts).cast("decimal(20,0)"))
    where = each.groupBy("kind", "value").agg(F.count("*").alias("n_e"), number().alias("_rows1"), number(F.lit(1)).alias("_rows2"))
    return each.join(where, ["kind", "value"]).select("_key", *_CLASS).distinct()


def _pairs(held: DataFrame, classes: DataFrame) -> DataFrame:
    """_key, class, term and whether it is like a name: each class with the terms of its rows that can tell of it, once per row."""
    terms = F.array_distinct(F.transform(_terms(F.col("_text"), F.col("_merged")), lambda w: w["term"]))
    names = F.transform(F.regexp_extract_all(F.col("_text"), F.lit(_NAMES), F.lit(0)), F.lower)
    texts = held.select("_key", terms.alias("_terms"), F.array_distinct(names).alias("_names"))
    rows = classes.join(texts.withColumn("_named", F.array_intersect("_terms", "_names")).drop("_names"), "_key")
    told = F.when(F.col("n_e") == 1, F.col("_named")).otherwise(F.col("_terms"))
    pairs = rows.select("_key", *_CLASS, F.explode(told).alias("term"), "_named")
    return pairs.select("_key", *_CLASS, "term", ((F.col("n_e") == 1) | F.array_contains("_named", F.col("term"))).alias("named"))


def disclosure(total: int) -> Column:
    """PMI / IC from n_e, n_t and n_et, with the entity's chance at the term at the lower end of its confidence interval."""
    n, share, z2 = F.col("n_t"), F.col("n_et") / F.col("n_t"), DEVIATIONS**2
    room = F.sqrt(share * (1 - share) / n + z2 / (4 * n * n)) * DEVIATIONS
    lowest = (share + z2 / (2 * n) - room) / (1 + z2 / n)
    content = F.log(F.lit(float(total)) / F.col("n_e"))
    return F.when(content > 0, F.log(lowest * F.lit(float(total)) / F.col("n_e")) / content)


def disclosing_terms(based: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of rows' classes and terms, and class, term, disclosure of the terms that are generalised or removed."""
    held = based.filter("_merged is not null")
    pairs = _pairs(held, _classes(held))
    joint = pairs.groupBy(*_CLASS, "term").agg(F.count("*").alias("n_et"), F.max("named").alias("named"))
    joint = joint.filter((F.col("n_et") > 1) | F.col("named"))
    # a word that a match cuts is not among the whole words of its text
    beside = F.array_except(F.transform(_terms(F.col("_text"), F.col("_merged")), lambda w: w["term"]), _whole_words(F.col("_text")))
    words = docs.select(F.explode(_whole_words(text_of())).alias("term")).unionAll(held.select(F.explode(beside)))
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"))
    total = max(1, based.count())
    told = joint.join(counts, "term").filter(_log_chance(total) <= F.log(F.lit(CHANCE)))
    scored = told.select(*_CLASS, "term", disclosure(total).alias("disclosure"))
    return pairs, scored.filter(F.col("disclosure") >= GENERALISE_FROM)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, _key, base spans and term spans (start, end, action) of every row of (doc_id, text)."""
    based = _based(docs)
    pairs, strong = disclosing_terms(based, docs)
    told = pairs.join(strong, [*_CLASS, "term"]).groupBy("_key", "term").agg(F.max("disclosure").alias("disclosure"))
    told = cut(told)
    held = based.filter("_merged is not null").join(told.select("_key").distinct(), "_key", "left_semi")
    places = held.select("_key", F.explode(_terms(F.col("_text"), F.col("_merged"))).alias("w")).select("_key", "w.*")
    marked = places.join(told, ["_key", "term"]).groupBy("_key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    span = F.struct(
        "start", "end", F.when(F.col("disclosure") >= REMOVE_FROM, "remove").otherwise("generalise").alias("action")
    )
    terms = marked.groupBy("_key").agg(F.array_sort(F.collect_list(span)).alias("terms"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,action:string>>")
    return based.join(terms, "_key", "left").select("doc_id", "_key", "base", F.coalesce("terms", empty).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with base spans and removed terms replaced by their kind, generalised terms by what they are."""
    found = find(docs).filter("size(base) > 0").dropDuplicates(["_key"])
    found = found.select(F.col("_key").alias("_pii_key"), F.col("base").alias("_pii_base"), F.col("terms").alias("_pii_terms"))
    text = F.col("text")
    terms = F.transform(
        "_pii_terms",
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "remove", "TERM").otherwise("WORD").alias("kind")),
    )
    base = F.transform("_pii_base", lambda s: F.struct(F.upper(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    keyed = docs.withColumn("_pii_key", _row_key()).join(found, "_pii_key", "left")
    keyed = keyed.withColumn("_pii_spans", F.when(F.col("_pii_base").isNotNull(), F.array_sort(F.concat(_merged(base), terms))))

    def written(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at("_pii_spans", F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
        name = F.substring(text, s["start"] + 1, F.lit(1))
        general = F.when(name != F.lower(name), "<NAME>").otherwise("<WORD>")
        mark = F.when(s["kind"] == "WORD", general).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.concat(F.substring(text, before + 1, s["start"] - before), mark)

    last = F.element_at("_pii_spans", -1)["end"]
    clean = F.concat(F.array_join(F.transform("_pii_spans", written), ""), F.substring(text, last + 1, F.length(text)))
    clean = F.when(F.col("_pii_spans").isNotNull(), clean).otherwise(text)
    columns = {"text": clean}
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        return keyed.select(*(columns.get(n, F.col(n)).alias(n) for n in docs.columns), "_pii_spans").select(
            *(
                F.when(F.col("_pii_spans").isNotNull(), count).otherwise(F.col(n)).alias(n) if n == "n_chars" else F.col(n)
                for n in docs.columns
            )
        )
    return keyed.select(*(columns.get(n, F.col(n)).alias(n) for n in docs.columns))
