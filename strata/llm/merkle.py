"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in DataFrame functions alone.

A text is cut losslessly: sections at two line feeds, paragraphs at one, and every paragraph into pieces that
end behind a mark or letter that its content decides (``PIECE``), so an edit moves no cut far from it. A piece
is hashed by MD5, a paragraph over its pieces' hashes, a section over its paragraphs', the root (SHA-256) over
the sections'. The cut loses nothing, so roots are equal just where texts are (but for collisions). Written down:

    root.n|section;paragraph:pieces;paragraph:pieces|section;...

with n distinct pieces, 16 hex digits a section or paragraph and 8 a piece. Two trees are compared from the top:
equal roots end it, equal sections and equal paragraphs are left out, and only the pieces of differing
branches meet. ``likeness`` is 1 - (pieces on one side only) / (n of both), ``changes`` locates differing
paragraphs by their place in the text.

``with_next`` gives every row the text that follows it in the order of an id, without sorting in one task: ids
alone are range-partitioned, the least id of each range is a bound (a real id, so no bucket is empty), and the
rows at a bound also go to the bucket before as guests. One shuffle of the texts; buckets grow in number with
``spark.sql.shuffle.partitions``. Rows that repeat one id share a bucket.

Defined results: null texts are empty; the empty text has one section of one paragraph without pieces; two
empty texts are alike by 1, an empty and another one by 0; equal ids follow each other by text (repeated rows
each once); null ids come first; the only row of a table follows itself; an empty table gives no rows; other
columns pass through (the added ones must not be there already).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A piece: up to a mark or one of two frequent final letters before a space, 14 to 96 characters; else 96, or the rest.
PIECE = r"(?s).{12,94}?[.,;:!?|es]\x20|.{1,96}"
SECTION, PARAGRAPH = "\n\n", "\n"
SECTION_MARK, PARAGRAPH_MARK, PIECES_MARK = "|", ";", ":"
NODE_DIGITS, PIECE_DIGITS = 16, 8
LONG = 1 << 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraph_node(paragraph: Column) -> Column:
    """(written, pieces): the paragraph's entry, and its pieces' short hashes."""
    hashes = F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0)), F.md5)

    def node(hs: Column) -> Column:
        return let(F.transform(hs, lambda h: F.substring(h, 1, PIECE_DIGITS)), lambda short: F.struct(
            F.concat(F.substring(F.md5(F.array_join(hs, "")), 1, NODE_DIGITS), F.lit(PIECES_MARK), F.array_join(short, "")).alias("written"),
            F.md5(F.array_join(hs, "")).alias("hash"), short.alias("pieces")))

    return let(hashes, node)


def section_node(section: Column) -> Column:
    def node(ps: Column) -> Column:
        digest = F.md5(F.array_join(F.transform(ps, lambda p: p["hash"]), ""))
        return let(digest, lambda d: F.struct(
            F.concat(F.substring(d, 1, NODE_DIGITS), F.lit(PARAGRAPH_MARK), F.array_join(F.transform(ps, lambda p: p["written"]), PARAGRAPH_MARK)).alias("written"),
            d.alias("hash"), F.array_distinct(F.flatten(F.transform(ps, lambda p: p["pieces"]))).alias("pieces")))

    return let(F.transform(F.split(section, PARAGRAPH), paragraph_node), node)


def fingerprint(text: Column) -> Column:
    """The written tree of a text."""
    def written(ss: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(ss, lambda s: s["hash"]), ""), 256)
        n = F.size(F.array_distinct(F.flatten(F.transform(ss, lambda s: s["pieces"]))))
        return F.concat(root, F.lit("."), n.cast("string"), F.lit(SECTION_MARK), F.array_join(F.transform(ss, lambda s: s["written"]), SECTION_MARK))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), SECTION), section_node), written)


def root(written: Column) -> Column:
    return F.substring_index(written, ".", 1)


def n_pieces(written: Column) -> Column:
    return F.substring_index(F.substring_index(written, SECTION_MARK, 1), ".", -1).cast("int")


def sections(written: Column) -> Column:
    return F.slice(F.split(written, r"\|"), 2, LONG)


def paragraphs(section: Column) -> Column:
    """Entries ``hash:pieces`` of a section."""
    return F.slice(F.split(section, PARAGRAPH_MARK), 2, LONG)


def pieces(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.substring_index(paragraph, PIECES_MARK, -1), F.lit(".{%d}" % PIECE_DIGITS), F.lit(0))


def below(nodes: Column, children: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(nodes, children))


def one_side(a: Column, b: Column) -> Column:
    """The number of pieces that only one of two sides has: (left, right) arrays of nodes, level by level."""
    def level(pair: Column, children) -> Column:
        return F.struct(below(F.array_except(pair["a"], pair["b"]), children).alias("a"),
                        below(F.array_except(pair["b"], pair["a"]), children).alias("b"))

    top = F.struct(sections(a).alias("a"), sections(b).alias("b"))
    return let(let(let(top, lambda s: level(s, paragraphs)), lambda p: level(p, pieces)),
               lambda x: F.size(F.array_except(x["a"], x["b"])) + F.size(F.array_except(x["b"], x["a"])))


def likeness(a: Column, b: Column) -> Column:
    """0 (nothing shared) to 1 (equal texts), of two written trees."""
    both = n_pieces(a) + n_pieces(b)
    return F.when(root(a) == root(b), F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(1.0 - one_side(a, b) / both)


def changes(a: Column, b: Column) -> Column:
    """Where a's tree differs from b's: array of (section, paragraph), counted from 0, of the paragraphs of a in
    differing sections that none of b's differing sections has."""
    def numbered(nodes: Column) -> Column:
        return F.transform(nodes, lambda x, i: F.struct(i.alias("place"), x.alias("node")))

    def located(others: Column) -> Column:
        missing = F.filter(numbered(sections(a)), lambda s: ~F.array_contains(sections(b), s["node"]))
        return F.flatten(F.transform(missing, lambda s: F.transform(
            F.filter(numbered(paragraphs(s["node"])), lambda p: ~F.array_contains(others, p["node"])),
            lambda p: F.struct(s["place"].alias("section"), p["place"].alias("paragraph")))))

    differing = let(F.struct(sections(a).alias("a"), sections(b).alias("b")), lambda s: below(F.array_except(s["b"], s["a"]), paragraphs))
    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.when(root(a) == root(b), none).otherwise(let(differing, located))


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter (rounded down) replaced by as many of the following text's first characters."""
    size, quarter = F.length(text), F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - quarter), F.substring(following, F.lit(1), quarter))


def id_bounds(docs: DataFrame, key: str, buckets: int) -> tuple[list, bool]:
    """The least id of each of at most ``buckets`` ranges of ids, in order, and whether there are null ids."""
    ids = docs.select(F.col(f"`{key}`").alias("id")).repartitionByRange(buckets, "id")
    found = ids.groupBy(F.spark_partition_id().alias("range")).agg(F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    return sorted(r["least"] for r in found if r["least"] is not None), any(r["nulls"] for r in found)


def bucket_of(x: Column, bounds: list, kind) -> Column:
    """The number of bounds that are not over x: found among every ``step``-th bound, then behind it. Null: 0."""
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    of = lambda values: F.array(*[F.lit(v).cast(kind) for v in values])
    row = F.size(F.filter(of([r[0] for r in rows]), lambda b: b <= x))
    return F.when(x.isNull(), 0).otherwise(let(row, lambda r: F.when(r == 0, 0).otherwise(
        (r - 1) * step + F.size(F.filter(F.get(F.array(*map(of, rows)), r - 1), lambda b: b <= x)))))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", added: str = "next_text",
              buckets: int | None = None, fingerprints: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the text (null: empty) of the next row by ``key``; behind the last row comes the first. With
    ``fingerprints`` (two names), also its own tree and the next row's."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, nulls = id_bounds(docs, key, buckets)
    if not bounds:
        bounds, first = [], F.lit(True)
    else:
        first = F.col("id").isNull() if nulls else F.col("id") == F.lit(bounds[0])
    kind = docs.schema[key].dataType
    own = F.struct(F.col("bucket"), F.lit(0).alias("place"))
    places = [own]
    if bounds:
        at_bound = F.array(*[F.lit(b).cast(kind) for b in bounds])
        before = F.when(F.array_contains(at_bound, F.col("id")), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("place")))
        places.append(before)
    places.append(F.when(first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("place"))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    rows = rows.withColumn("bucket", bucket_of(F.col("id"), bounds, kind) if bounds else F.lit(0))
    dealt = (rows.select("row", "id", "body", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p"))
             .select(F.when(F.col("p.place") == 0, F.col("row")).alias("row"), "id", "body", "p.bucket", "p.place"))
    order = Window.partitionBy("bucket").orderBy("place", "id", "body")
    found = dealt.withColumn("following", F.lead("body").over(order))
    names = [F.col("following").alias(added)]
    if fingerprints:
        found = found.withColumn("tree", fingerprint(F.col("body"))).withColumn("next_tree", F.lead("tree").over(order))
        names += [F.col("tree").alias(fingerprints[0]), F.col("next_tree").alias(fingerprints[1])]
    return found.where("place = 0").select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *names)


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``docs`` with next_text, edited_text, fingerprint, edited_fingerprint, near_edited and near_next."""
    rows = with_next(docs, key, text, "next_text", buckets, ("fingerprint", "next_fingerprint"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = rows.withColumn("edited_text", edited(body, F.col("next_text"))).withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    return (rows.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
            .withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint"))).drop("next_fingerprint"))
