"""Information-theoretic sanitisation of personal data.

Patterns find protected entities: mail addresses, IP addresses, card and phone numbers. A term near an entity discloses
the share of the entity's information that knowing the term gives away: the pointwise mutual information of term and
entity over the information of the entity, from counts over all distinct contents of the corpus. Terms that disclose at least ``GENERAL``
are generalised, at least ``REMOVED`` removed; the patterns' own spans always go. Near are the ``NEAR`` whole words on
either side, however far they stand. Nearness only serves to measure: a term goes wherever it stands in a text that holds its entity. In texts that do not hold the entity it stays.

Only repeated evidence counts: a term must stand near the entity in ``CONTEXTS`` different contexts, told apart by the
words next to the entity, so that copies of one text are one context. Results depend on text alone: spans are found per
distinct content and joined to every row. Null text is empty; rows without spans are returned with none.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelore.session import cut_lineage

from .common import AT_ONCE, SIEVE_BITS, Rows, packed_sieve, pair, rows_of, sieve

#: Kinds in the order of the contract, then those the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "removed", "general")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "", "general": "[TERM]"}

#: Words on either side of an entity, contexts a pair needs, and the disclosed shares from which a term goes.
NEAR, CONTEXTS, GENERAL, REMOVED = 8, 2, 0.85, 0.95

_WORD = re.compile(r"[^\W\d_]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
_TERM = pa.struct([("entity", pa.string()), ("context", pa.string()), ("term", pa.string()),
                   ("start", pa.int32()), ("end", pa.int32())])
FOUND = ("doc_id long, blob binary, spans array<struct<start: int, kind: string, end: int>>, entities array<string>, "
         "terms array<struct<entity: string, context: string, term: string, start: int, end: int>>")
PLACES = "blob binary, term string, places array<struct<start: int, end: int>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Looks left and right of every at sign, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four patterns, by start and then kind."""
    spans = [(a, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            spans.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            spans.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append((m.start(), "phone", m.end()))
    return sorted(spans, key=lambda x: (x[0], BASE.index(x[1])))


def entity(text: str, start: int, kind: str, end: int) -> str:
    """The name of the entity of a span, the same for all its spellings."""
    value = text[start:end].lower() if kind == "email" else _NOT_DIGIT.sub("." if kind == "ip" else "", text[start:end])
    return f"{kind}:{value}"


def near_terms(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[str, str, str, int, int]]:
    """(entity, context, term, start, end) of the words on either side of each span, however far, outside all spans."""
    words = [(w, a, b) for w, a, b in words_outside(text, spans) if not _cut(text, a, b)] if spans else []
    starts = [a for _, a, _ in words]
    found = []
    for start, kind, end in spans:
        before, after = bisect_left(starts, start), bisect_left(starts, end)
        sides = words[max(0, before - NEAR):before], words[after:after + NEAR]
        context = " ".join(w for w, _, _ in sides[0][-2:] + [("|", 0, 0)] + sides[1][:2])
        name = entity(text, start, kind, end)
        found += [(name, context, *x) for side in sides for x in side]
    return found


def _cut(text: str, start: int, end: int) -> bool:
    """Whether a word goes on across the border of a span."""
    return bool(start and _WORD.match(text[start - 1]) or end < len(text) and _WORD.match(text[end]))


def words_outside(text: str, spans: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all words between the spans, which are sorted by start."""
    at = 0
    for start, _, end in [*spans, (len(text), "", len(text))]:
        if start > at:
            yield from ((m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text, at, start))
        at = max(at, end)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    out = Rows(pa.schema([("doc_id", pa.int64()), ("blob", pa.binary()), ("spans", pa.list_(_SPAN)),
                          ("entities", pa.list_(pa.string())), ("terms", pa.list_(_TERM))]))
    for ident, text in rows_of(batches, "doc_id", "text"):
        spans = base_spans(text)
        terms = near_terms(text, spans)
        row = (ident, hashlib.sha256(text.encode()).digest(), [dict(zip(("start", "kind", "end"), x)) for x in spans],
               sorted({entity(text, *x) for x in spans}), [dict(zip(("entity", "context", "term", "start", "end"), x)) for x in terms])
        if out.add(*row, size=100 * (len(terms) + len(spans))):
            yield from out.take()
    yield from out.take()


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the content's address, the base spans, their entities, and the terms near them."""
    return pair(docs, doc_id, text).mapInArrow(_find, FOUND)


def _place(sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        bits, place = sieve.value, pa.struct([("start", pa.int32()), ("end", pa.int32())])
        out = Rows(pa.schema([("blob", pa.binary()), ("term", pa.string()), ("places", pa.list_(place))]))
        for (text,) in rows_of(batches, "text"):
            spans, places = base_spans(text), {}
            for term, start, end in words_outside(text, spans) if spans else ():
                if term not in places:
                    at = zlib.crc32(term.encode()) % SIEVE_BITS
                    places[term] = [] if bits[at >> 3] >> (at & 7) & 1 else None
                if places[term] is not None:
                    places[term].append({"start": start, "end": end})
            blob = hashlib.sha256(text.encode()).digest() if spans else b""
            for term, found in places.items():
                if found and out.add(blob, term, found, size=50 + 20 * len(found)):
                    yield from out.take()
        yield from out.take()
    return run


def placed(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Per content with base spans and term: all ``places`` of the term in it, outside the spans.

    Holds the ``terms`` given and, as words are first tried against a sieve, perhaps a few others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(packed_sieve(sieve(terms)))
    texts = docs.select(F.coalesce(docs[text], F.lit("")).alias("text"))
    return texts.mapInArrow(_place(sent), PLACES).dropDuplicates(["blob", "term"])


def distinct_texts(docs: DataFrame, repeated: DataFrame, text: str = "text") -> DataFrame:
    """``text`` of each content once, a null text being empty. ``repeated`` are the ``blob`` of several rows.

    Only rows that a sieve does not exclude from the repeated ones are shuffled to be merged.
    """
    plain = docs.select(F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    marked = plain.withColumn("at", F.crc32("blob") % SIEVE_BITS).withColumn("slot", F.expr("cast(at div 64 AS int)"))
    marked = marked.join(F.broadcast(sieve(repeated)), "slot", "left").withColumn(
        "again", F.expr("coalesce(bits & shiftleft(1L, cast(at % 64 AS int)), 0L) <> 0"))
    return marked.filter("NOT again").select("text").unionByName(
        marked.filter("again").select("blob", "text").dropDuplicates(["blob"]).select("text"))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term`` and the number of rows that hold it, for every lower-cased word of the corpus."""
    words = F.array_distinct(F.split(F.lower(docs[text]), r"[^\p{L}\p{Nl}\p{No}]+"))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing(mentions: DataFrame, frequencies: DataFrame, n_docs: int, contexts: int = CONTEXTS,
               general: float = GENERAL, removed: float = REMOVED) -> DataFrame:
    """``entity``, ``term`` and ``kind`` (removed or general) of the pairs whose disclosure exceeds a threshold."""
    each = mentions.select("entity", "context", "term").distinct()
    of_entity = each.select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= contexts)
    joined = pairs.join(of_entity, "entity").join(frequencies, "term")
    both = F.col("n_both") * F.lit(float(max(n_docs, 2))) / (F.col("n_entity") * F.greatest("n_term", "n_both"))
    share = F.log(both) / F.log(F.greatest(F.lit(float(max(n_docs, 2))) / F.col("n_entity"), F.lit(1.0 + 1e-9)))
    kind = F.when(share >= removed, "removed").when(share >= general, "general")
    return joined.select("entity", "term", kind.alias("kind")).filter("kind IS NOT NULL")


def term_spans(docs: DataFrame, seen: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """Per content with disclosing terms: their spans. ``seen`` is the stored result of ``found``."""
    mentions = cut_lineage(seen.filter(F.size("terms") > 0).dropDuplicates(["blob"])
                           .select("blob", F.explode("terms").alias("t")).select("blob", "t.*"))
    contents = cut_lineage(seen.groupBy("blob").agg(F.count(F.lit(1)).alias("n")))
    texts = distinct_texts(docs, contents.filter("n > 1").select("blob"), text)
    flagged = cut_lineage(disclosing(mentions, document_frequencies(texts), contents.count(), **thresholds), few=True)
    held = seen.select("blob", F.explode("entities").alias("entity")).distinct()
    everywhere = placed(docs, flagged.select("term"), text).join(flagged, "term").join(held, ["blob", "entity"])
    # A term of two entities goes by the stronger measure.
    spans = everywhere.select("blob", "kind", F.inline("places")).groupBy("blob", "start", "end").agg(F.max("kind").alias("kind"))
    return spans.groupBy("blob").agg(F.collect_list(F.struct("start", "kind", "end")).alias("term_spans"))


def private_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """Per row: ``doc_id`` and ``spans`` (start, kind, end), of the patterns and of the disclosing terms."""
    seen = cut_lineage(found(docs, doc_id, text))
    joined = seen.join(term_spans(docs, seen, text, **thresholds), "blob", "left")
    return joined.select("doc_id", F.concat("spans", F.coalesce("term_spans", F.array().cast(
        "array<struct<start: int, kind: string, end: int>>"))).alias("spans"))


def rendered(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of the given kinds, by start and then kind, with commas between."""
    order = F.array(*(F.lit(x) for x in kinds))
    sorted_ = F.array_sort(F.transform(F.filter(spans, lambda x: F.array_contains(order, x.kind)), lambda x: F.struct(
        x.start.alias("start"), F.array_position(order, x.kind).alias("at"), x.kind.alias("kind"), x.end.alias("end"))))
    return F.array_join(F.transform(sorted_, lambda x: F.concat_ws(
        ":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("bigint")


def cleaned(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced by its label; of overlapping spans the first goes first."""
    parts, at = [], 0
    for start, kind, end in sorted(spans, key=lambda x: (x[0], -x[2])):
        if start >= at:
            parts += [text[at:start], LABELS[kind]]
        at = max(at, end)
    return "".join(parts) + text[at:]


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            texts = [None if t is None else cleaned(t, base_spans(t) + [(x["start"], x["kind"], x["end"]) for x in more or ()])
                     for t, more in zip(part.column("text").to_pylist(), part.column("term_spans").to_pylist())]
            kept = [k for k, n in enumerate(part.schema.names) if n != "term_spans"]
            columns = [pa.array(texts, pa.string()) if part.schema.names[k] == "text" else part.column(k) for k in kept]
            yield pa.RecordBatch.from_arrays(columns, [part.schema.names[k] for k in kept])


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """The same rows and columns with ``text`` sanitised; a null text stays null. Needs ``doc_id`` and ``text``."""
    seen = cut_lineage(found(docs))
    blob = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    # Column names are replaced on the way, so that none can clash with the two joined.
    plain = docs.select("text", *(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(docs.columns) if n != "text"), blob.alias("blob"))
    spans = term_spans(docs, seen, **thresholds)
    joined = plain.join(spans, "blob", "left").drop("blob")
    schema = joined.drop("term_spans").schema
    made = joined.mapInArrow(_clean, schema)
    return made.select(*("text" if n == "text" else F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)))
