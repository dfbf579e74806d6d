"""Line deduplication by a tree of line templates.

Tokens with a digit are variable fields and are masked. A line's leaf in the tree is its number of
tokens and its leading tokens. The most frequent masked line of a leaf is its template; another line
of the leaf belongs to it if enough tokens at the same places are equal, and the places that differ
are further variable fields; else the masked line is a template of its own. Lines of a template that
recurs across documents, that is in enough different ones, are dropped, all but the first.

Everything is DataFrame operations. Lines are shuffled as hashes; text moves once to compare
lines of a leaf, and once to apply the marks to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voteframe.session import cut_lineage

MIN_DOCS = 5
MIN_TOKENS = 1
LEADING = 3
SIMILARITY = 0.7
BLANKS = " \t\n\f\r"
_GAP = f"[{BLANKS}]++"
#: A token with a digit, from its start; possessive, so that long tokens take linear time.
_FIELD = f"(?<![^{BLANKS}])[^{BLANKS}0-9]*+[0-9][^{BLANKS}]*+"


def masked(plain: Column) -> Column:
    """A line that has no outer blanks, its tokens with digits masked."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, _FIELD, "<*>")).otherwise(plain)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_hash(line: Column) -> Column:
    return F.xxhash64(masked(trimmed(line)))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, pos, masked`` for every line of at least one token."""
    split = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split).alias("pos", "line"))
    # Only the trimming is done again by the filter, which Spark moves down; masking is done once.
    rows = rows.select("doc_id", "pos", trimmed(F.col("line")).alias("plain")).where("plain <> ''")
    return rows.select("doc_id", "pos", masked(F.col("plain")).alias("masked"))


def recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS, leading: int = LEADING, similarity: float = SIMILARITY,
) -> DataFrame:
    """``doc_id, drop, keep``: hashes of the masked lines to drop in a document, and the positions
    of the lines that stay because they are the first of their template."""
    lines = lines_of(docs, id_col, text_col)
    placed = lines.select("doc_id", "pos", F.xxhash64("masked").alias("line"), F.split("masked", _GAP).alias("tokens"))
    if min_tokens > 1:
        placed = placed.where(F.size("tokens") >= min_tokens)
    placed = placed.select("doc_id", "pos", "line", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, leading)).alias("leaf"))
    held = cut_lineage(placed.groupBy("doc_id", "line", "leaf").agg(F.min("pos").alias("pos")), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos")
    variants = held.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.min(place).alias("first"))
    leaves = variants.groupBy("leaf").agg(
        F.sum("docs").alias("all"), F.count(F.lit(1)).alias("variants"),
        F.min_by("line", F.struct(-F.col("docs"), "first")).alias("seed"),
    ).where(F.col("all") >= min_docs)
    shared = cut_lineage(variants.join(leaves, "leaf"), "variants")
    mixed = shared.where("variants > 1").select("line", "leaf", "seed")
    texts = lines.select(F.xxhash64("masked").alias("line"), "masked").join(mixed.select("line"), "line", "left_semi")
    texts = texts.groupBy("line").agg(F.first("masked").alias("masked"))
    tokens = mixed.join(texts, "line").withColumn("tokens", F.split("masked", _GAP)).drop("masked")
    tokens = cut_lineage(tokens, "templates")
    seeds = tokens.where("line = seed").select("leaf", F.col("tokens").alias("template"))
    equal = F.size(F.filter(F.zip_with("tokens", "template", lambda a, b: a == b), lambda x: x))
    joined = tokens.join(seeds, "leaf").where(equal >= F.lit(similarity) * F.size("tokens")).select("line", F.lit(True).alias("joins"))
    named = shared.join(joined, "line", "left").withColumn("template", F.when(F.col("joins"), F.col("seed")).otherwise(F.col("line")))
    templates = named.groupBy("leaf", "template").agg(
        F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("lines"), F.min("first").alias("kept")
    ).where(F.col("docs") >= min_docs)
    # A document may hold several masked lines of a template: then documents are counted, not lines.
    several = named.join(templates.where("lines > 1").select("leaf", "template"), ["leaf", "template"]).select("line", "template")
    holding = held.join(several, "line").groupBy("leaf", "template", "doc_id").agg(F.lit(1).alias("one"))
    enough = holding.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    often = templates.where("lines = 1").select("leaf", "template", "kept").unionByName(
        templates.drop("docs", "lines").join(enough.select("leaf", "template"), ["leaf", "template"])
    )
    dropped = named.select("line", "leaf", "template").join(often, ["leaf", "template"]).select("line", "kept")
    marks = held.join(dropped, "line")
    is_first = F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.pos") == F.col("pos"))
    return marks.groupBy("doc_id").agg(
        F.collect_set("line").alias("drop"), F.collect_set(F.when(is_first, F.col("pos"))).alias("keep")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, without recurring lines, and ``__lines`` and ``__dropped``: the
    numbers of lines before and of lines dropped.

    A template recurs if ``min_docs`` different documents hold one of its lines. Lines without a token
    stay, and with ``min_tokens`` those of fewer tokens. Of a template the line in the
    smallest document (null ids last), at the smallest position, stays. Rows that share an id are
    one document. A null text stays null, with no lines; an empty text has one empty line.
    """
    marks = recurring_lines(docs, id_col, text_col, **options).withColumnRenamed("doc_id", "__id")
    joined = docs.join(marks.select("__id", F.col("drop").alias("__drop"), F.col("keep").alias("__keep")),
                       F.col(id_col).eqNullSafe(F.col("__id")), "left")
    split = F.split(F.col(text_col).cast("string"), "\n")
    stays = lambda line, at: ~F.array_contains("__drop", line_hash(line)) | F.array_contains("__keep", at)
    rest = F.when(F.col("__drop").isNotNull(), F.filter(split, stays)).otherwise(split)
    counted = joined.withColumn("__rest", rest).withColumn("__lines", F.coalesce(F.size(split), F.lit(0)))
    counted = counted.withColumn("__lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__lines")))
    left = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__rest"))
    counted = counted.withColumn("__dropped", F.col("__lines") - left)
    text = F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(F.concat_ws("\n", "__rest"))
    return counted.withColumn(text_col, text).select(*docs.columns, "__lines", "__dropped")


#: The same in another engine's SQL. Its regular expressions are linear without possessive forms.
LINE_SQL = r"""
with raw as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (select doc_id, i - 1 as pos, parts[i] as line,
    regexp_replace(regexp_replace(parts[i], '^\s+|\s+$', '', 'g'), '\S*\d\S*', '<*>', 'g') as masked
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from raw)),
parsed as (select *, regexp_extract_all(masked, '\S+') as tokens from lines),
leafed as (select *, len(tokens) as n, array_to_string(tokens[1:3], ' ') as head from parsed where len(tokens) >= 1),
held as (select doc_id, masked, n, head, any_value(tokens) as tokens, min(pos) as pos from leafed group by doc_id, masked, n, head),
variants as (select masked, n, head, any_value(tokens) as tokens, count(*) as docs, min(row(doc_id, pos)) as first from held group by masked, n, head),
ranked as (select *, sum(docs) over (partition by n, head) as total,
    first_value(masked) over w as seed, first_value(tokens) over w as template
  from variants window w as (partition by n, head order by docs desc, first)),
named as (select *, case when len(list_filter(range(1, n + 1), lambda i: tokens[i] = template[i])) >= 0.7 * n then seed else masked end as name
  from ranked where total >= 5),
often as (select n, head, name, min(first) as kept from named join held using (masked, n, head) group by n, head, name having count(distinct doc_id) >= 5),
marks as (select named.masked, often.kept from named join often using (n, head, name)),
judged as (select lines.doc_id, lines.pos, lines.line, marks.masked is not null
    and not (row(lines.doc_id, lines.pos) = marks.kept) as dropped
  from lines left join marks on lines.masked = marks.masked)
select doc_id, count(*) as n_lines, sum(dropped::int)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""
