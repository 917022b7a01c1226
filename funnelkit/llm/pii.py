"""Personal data with information-theoretic sanitisation.

Base spans: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers.  Each distinct value is
a protected entity, and so is each part that values share (an address's domain and local words, an IP
address's first three numbers).  Terms (letter runs, lower-cased; one of up to ``SHORT`` letters is met beside a value only where it
is not written small, as names and scripts without case are) within ``CONTEXT`` code points of an
entity co-occur with it.  Over the corpus, ``n(t)`` texts hold a term, ``n(e)`` hold an entity, and ``n(t, e)`` have them
side by side (distinct texts each).  A term discloses an entity if

* the chance that a text with the term has the entity, smoothed by ``SMOOTH`` texts of the corpus,
  ``c = (n(t, e) + SMOOTH n(e) / N) / (n(t) + SMOOTH)``, is ``MIN_CHANCE`` or more, and
* it gives ``MIN_SHARE`` or more of the information that the entity bears: pointwise mutual information over
  ``-log(n(e) / N)``, that is ``1 - log(c) / log(n(e) / N)``.  A term that always goes with the entity has
  a share near 1 however frequent the entity and however small the table; an entity that all texts have bears none, and
* that is not chance, with ``MIN_EVIDENCE`` or more.  Background: words of about equal frequency and equal case (always
  capitalised or not).  With ``b`` the share of the corpus's letters that stand beside a value, a class with ``A`` (term, text)
  pairs has ``b A`` beside values by chance; ``B`` are.  ``q = min(1, b A / B)`` is the chance that such a word is there by chance,
  and each further text with the same entity beside it is so by ``b``: the evidence is ``1 - q b^(n(t, e) - 1)``.
  So a word that the corpus has once discloses only where such words crowd around values, as names do.

Every occurrence of a disclosing term in a document with its entity becomes a span of kind ``term``;
base spans stay.  ``sanitised`` replaces base spans by their kind in brackets (generalised) and drops terms.

All of it is DataFrame expressions.  Only documents that may have base spans make rows of words; the vocabulary of the
whole corpus is one partial aggregation over each text's distinct words, which bounds and classes the terms' frequencies; the texts
with base spans bound them too; exact ones are counted for the terms that both bounds leave open.  Words and
entities meet through a join on (document, position bin), linear in a document's length.

Null texts are empty.  Rows with equal doc_id and equal text are one document with one result, given for
each row; counts are of distinct texts, so copies and repeated rows change none.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.shared import text_key, written
from funnelkit.llm.spans import KEY, collected, joined, matches

PATTERNS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
BASE = [k for k, _ in PATTERNS]
#: Every text with a base span has this; it finds them without moving a text.
LIKELY = (r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"
          r"|[0-9](?:[\x20-]?[0-9]){13}|\+[0-9][\x20().0-9-]+[0-9]")
KINDS = [*BASE, "term"]
CONTEXT = 60
SMOOTH = 1
MIN_CHANCE = 0.5
MIN_SHARE = 0.5
MIN_EVIDENCE = 0.75
#: Texts fall on this many places by their keys; a term's places bound its texts from below and class it.
PLACES = 64
SHORT = 3


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the check sum: every second digit from the right counts double."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: F.substr(back, i, F.lit(1)).cast("int"))
    each = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise((d * 2) % 10 + F.when(d >= 5, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x) % 10 == 0


def base_spans(texts: DataFrame) -> DataFrame:
    """Base matches of ``texts`` (doc_id, text_key, text) that hold."""
    found = matches(texts, PATTERNS).withColumn("digits", F.regexp_replace("value", "[^0-9]+", ""))
    size = F.char_length("digits")
    card = F.when(size.between(14, 19), _luhn(F.col("digits"))).otherwise(False)
    parts = F.transform(F.split("value", r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: F.when(F.char_length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    holds = F.when(F.col("kind") == "card", card).when(F.col("kind") == "ip", ip).when(
        F.col("kind") == "phone", size.between(10, 15)).otherwise(True)
    return found.filter(holds).drop("digits")


def _entities() -> Column:
    """Hashes of a base match (kind, value) and of the parts that others may share with it."""
    low = F.lower("value")
    parts = F.when(F.col("kind") == "email", F.concat(
        F.array(F.xxhash64(F.lit("domain"), F.substring_index(low, "@", -1))),
        F.transform(F.regexp_extract_all(F.substring_index(low, "@", 1), F.lit(r"\p{L}+"), F.lit(0)),
                    lambda w: F.xxhash64(F.lit("local"), w))))
    parts = parts.when(F.col("kind") == "ip", F.array(F.xxhash64(F.lit("network"), F.substring_index(low, ".", 3))))
    return F.concat(F.array(F.xxhash64("kind", low)), F.coalesce(parts, F.array().cast("array<bigint>")))


def _words(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end, term and named (longer than ``SHORT`` or not written small) of the words of ``texts``."""
    found = matches(texts, [("term", r"\p{L}++")])
    first = F.substring("value", 1, 1)
    named = (F.char_length("value") > SHORT) | (first == F.upper(first))
    return found.select(*KEY, "start", "end", F.lower("value").alias("term"), named.alias("named"))


def _terms(texts: DataFrame) -> DataFrame:
    """term, text_key, capital (the word starts with a capital) of the distinct words of each row of ``texts``."""
    words = texts.select("text_key", F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("word")).filter("word <> ''")
    first = F.substring("word", 1, 1)
    return words.select(F.lower("word").alias("term"), "text_key", (first != F.lower(first)).alias("capital"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """term, places (1 to PLACES; never more than its distinct texts), capital (always so) of every term."""
    places = F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, cast(text_key & {PLACES - 1} as int))"))).cast("int")
    return _terms(texts).groupBy("term").agg(places.alias("places"), F.bool_and("capital").alias("capital"))


def term_frequency(texts: DataFrame, held: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """term, places, capital, n_texts (distinct texts) of the terms of ``pairs`` (term, n_both) that may have ``MIN_CHANCE``.

    Two bounds from below leave terms open: their places in the vocabulary ``known``, and their distinct texts among ``held`` (the
    texts with base spans, some of ``texts``).  Places end at ``PLACES``; the second grows with the corpus, so words that
    many texts have, beside values or not, are settled by it.  Only open terms send a row a text of the whole corpus."""
    most = pairs.groupBy("term").agg(F.max("n_both").alias("most"))
    least = _terms(held).groupBy("term").agg(F.countDistinct("text_key").alias("n_held"))
    open_ = known.join(most, "term").filter(MIN_CHANCE * (F.col("places") + SMOOTH) <= F.col("most") + SMOOTH)
    open_ = open_.join(least, "term").filter(MIN_CHANCE * (F.col("n_held") + SMOOTH) <= F.col("most") + SMOOTH)
    open_ = written(open_.select("term", "places", "capital"), "open")
    counts = _terms(texts).join(open_.select("term"), "term").groupBy("term").agg(F.countDistinct("text_key").alias("n_texts"))
    return counts.join(open_, "term")


def by_chance(known: DataFrame, beside: DataFrame, total: DataFrame) -> DataFrame:
    """places, capital, b, q of every class of terms beside values (at most two a place).

    ``known``: vocabulary; ``beside``: term, text_key, c, d of the words beside values; ``total``: one row with n_letters."""
    held = beside.groupBy("term", "text_key").agg(F.sum(F.col("d") - F.col("c")).alias("letters"))
    held = held.groupBy("term").agg(F.count("*").alias("near"), F.sum("letters").alias("letters"))
    near = known.join(held, "term").groupBy("places", "capital").agg(F.sum("near").alias("near"), F.sum("letters").alias("letters"))
    # texts from places by linear counting; where all places are taken, nothing is told from the class
    texts = F.when(F.col("places") == 1, 1.0).when(F.col("places") < PLACES, -PLACES * F.log(1 - F.col("places") / PLACES))
    pairs = known.groupBy("places", "capital").agg((F.count("*") * F.first(texts)).alias("pairs"))
    b = F.least(F.lit(1.0), F.col("all_near") / F.col("n_letters"))
    both = near.join(pairs, ["places", "capital"]).crossJoin(F.broadcast(near.agg(F.sum("letters").alias("all_near"))))
    both = both.crossJoin(F.broadcast(total.select("n_letters"))).withColumn("b", b)
    return both.select("places", "capital", "b", F.least(F.lit(1.0), F.coalesce(F.col("b") * F.col("pairs") / F.col("near"), F.lit(1.0))).alias("q"))


def disclosures(spans: DataFrame, words: DataFrame, texts: DataFrame) -> DataFrame:
    """term, entity (hash) of the terms that disclose an entity, from base spans and word matches."""
    span = spans.select(*KEY, "entities", F.col("start").alias("a"), F.col("end").alias("b"))
    span = span.withColumn("bin", F.explode(F.sequence(F.floor((F.col("a") - CONTEXT) / CONTEXT), F.floor((F.col("b") + CONTEXT) / CONTEXT))))
    word = words.select(*KEY, "term", "named", F.col("start").alias("c"), F.col("end").alias("d"), F.floor(F.col("start") / CONTEXT).alias("bin"))
    s, w = span.alias("s"), word.alias("w")
    near = w.join(s, F.col("w.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("w.text_key") == F.col("s.text_key"))
                  & (F.col("w.bin") == F.col("s.bin")) & (F.col("c") >= F.col("a") - CONTEXT) & (F.col("c") <= F.col("b") + CONTEXT)
                  & ((F.col("d") <= F.col("a")) | (F.col("c") >= F.col("b"))))
    near = written(near.select("term", "named", "entities", "w.text_key", "c", "d").distinct(), "beside")
    pairs = near.filter("named").select("term", F.explode("entities").alias("entity"), "text_key").distinct()
    pairs = written(pairs.groupBy("term", "entity").agg(F.count("*").alias("n_both")), "pairs")
    entities = spans.select(F.explode("entities").alias("entity"), "text_key").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    known = written(vocabulary(texts), "vocabulary")
    letters = F.char_length(F.regexp_replace("text", r"[^\p{L}]++", ""))
    total = texts.select("text_key", F.coalesce(letters, F.lit(0)).alias("letters")).groupBy("text_key").agg(F.max("letters").alias("letters"))
    total = written(total.agg(F.count("*").alias("n_all"), F.sum("letters").alias("n_letters")), "total")  # one row
    classes = by_chance(known, near.select("term", "text_key", "c", "d").distinct(), total)
    held = texts.filter(F.col("text").rlike(LIKELY))
    found = pairs.join(term_frequency(texts, held, known, pairs), "term").join(entities, "entity").join(F.broadcast(classes), ["places", "capital"])
    common = F.col("n_entity") / F.col("n_all")
    chance = (F.col("n_both") + SMOOTH * common) / (F.col("n_texts") + SMOOTH)
    share = F.when(common < 1, 1 - F.log(chance) / F.log(common))
    evidence = 1 - F.col("q") * F.pow("b", F.col("n_both") - 1)
    found = found.crossJoin(F.broadcast(total)).filter(
        (F.round(chance, 9) >= MIN_CHANCE) & (F.round(share, 9) >= MIN_SHARE) & (F.round(evidence, 9) >= MIN_EVIDENCE))
    return found.select("term", "entity")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans and ``list`` (sorted
    structs start, rank, end, kind) for each row of ``docs``."""
    texts = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    # the texts that may have base spans, each once, dealt by document: what follows them needs no further dealing
    held = texts.filter(F.col("text").rlike(LIKELY)).dropDuplicates(KEY)
    spans = written(base_spans(held).withColumn("entities", _entities()), "personal")
    telling = written(disclosures(spans, _words(held), texts), "telling")
    here = written(spans.select(*KEY, F.explode("entities").alias("entity")).distinct().join(telling, "entity").select(*KEY, "term").distinct(), "here")
    x = here.select(*KEY).distinct().alias("x")
    marked = held.alias("t").join(x, F.col("t.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("t.text_key") == F.col("x.text_key")), "left_semi")
    w, x = _words(marked).alias("w"), here.alias("x")
    terms = w.join(x, F.col("w.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("w.text_key") == F.col("x.text_key")) & (F.col("w.term") == F.col("x.term")))
    terms = terms.select("w.doc_id", "w.text_key", F.lit("term").alias("kind"), "start", "end")
    each = collected(spans.select(*KEY, "kind", "start", "end").unionByName(terms), KINDS,
                     F.collect_set(F.when(F.col("kind") != "term", F.struct("start", "end"))).alias("base"),
                     *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in BASE])
    # a term inside an address is part of it already
    each = each.withColumn("list", F.expr(
        "filter(list, s -> s.kind <> 'term' or not exists(base, b -> b.start < s.end and s.start < b.end))")).drop("base")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_key(F.col("text")).alias("text_key"))
    out = rows.alias("r").join(each.alias("e"), F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.text_key") == F.col("e.text_key")), "left")
    empty, none = F.lit(""), F.lit(0).cast("long")
    return out.select(
        "row", "r.doc_id", "r.text_key", *[F.coalesce(f"e.n_{k}", none).alias(f"n_{k}") for k in BASE],
        F.coalesce(F.expr("size(filter(e.list, s -> s.kind = 'term'))").cast("long"), none).alias("n_term"),
        F.sha2(F.coalesce(joined(F.filter("e.list", lambda s: s["kind"] != "term")), empty), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("e.list")), empty).alias("spans"), "e.list")


def sanitise(found: DataFrame) -> DataFrame:
    """Rows of a ``scan`` with ``sanitised``: base spans generalised to [KIND], disclosing terms removed.

    Spans are cut from the end to the start, so earlier positions hold; overlapping spans go with the
    first of them."""
    text = F.col("row.text")
    merged = F.aggregate(
        "list", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")),
                     F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))))
    done = found.withColumn("cut", F.when(F.size("list") > 0, merged))
    tail = F.substring(text, (F.col("cut.at") + 1).cast("int"), F.char_length(text))
    return done.withColumn("sanitised", F.when(F.col("cut").isNull(), text).otherwise(F.concat("cut.out", tail))).drop("cut")
