"""Line dedup by a log-template tree of fixed depth; DataFrame operations only.

A line falls from the root by its number of tokens and then by its LEAD leading tokens, tokens with digits being the
wildcard: that is its leaf. Within a leaf, a token stays where at least ``min_docs`` (document, line) pairs have it at
its place, and any other is a variable field; the line with its fields as wildcards is its template. A template counts
if the share of its tokens that stay is at least ``similarity``; one that ``min_docs`` documents have is dropped from
all of them. Prose lines that share a leaf by chance keep few of their tokens, so they have no template.

Only lines of leaves that enough documents reach are looked at twice. Leaves are broadcast up to BROADCAST_LEAVES, else
joined by shuffle; equal lines are counted together before anything is exploded, so hot lines are one row per task, and
hot lines and templates are broadcast (join_groups) instead of joined by key. Lines and templates are named by 128 bits.

Defined results: a null text counts as empty; blank lines are never dropped; lines end at \\n and keep their other
characters; tokens are separated by single spaces, after tabs and carriage returns count as spaces and ends are trimmed;
rows that repeat id and text count once and get equal results; a null id is kept; lines and tokens of any length are
read whole, in one pass; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import join_groups, materialise, table

LEAD = 3
#: Ways down the tree of relative_lines, by windows of a line's tokens: fields in some of them leave the others.
WINDOWS = 4
MIN_DOCS = 5
SIMILARITY = 0.7
BROADCAST_LEAVES = 200_000
#: What stands for a variable field, and the tokens that are one by themselves. A token is tried at its start only and
#: never twice, so a text's length in one token costs one pass.
WILDCARD, VARIABLE = "<*>", "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def _name(*parts: Column) -> Column:
    """128 bits that stand for strings and numbers: enough for any corpus without a collision."""
    return F.unhex(F.md5(F.concat_ws("\n", *[p.cast("string") for p in parts])))


def _plain(line: Column) -> Column:
    # Two searches that mostly find nothing cost less than a translation of every character.
    return F.trim(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))


def _leaf(plain: Column) -> Column:
    """The path in the tree: token count and leading tokens."""
    count = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return _name(count, F.regexp_replace(F.substring_index(plain, " ", LEAD), VARIABLE, WILDCARD))


def _lines(docs: DataFrame) -> DataFrame:
    """id, h (of the text), place, plain, leaf of every line that isn't blank."""
    rows = docs.select("id", "h", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("plain", _plain(F.col("line")))
    return rows.where("plain <> ''").select("id", "h", "place", "plain", _leaf(F.col("plain")).alias("leaf"))


def _forms(found: DataFrame) -> DataFrame:
    """Equal lines once: key, leaf, masked, n (documents that have them) and rows (lines)."""
    each = found.groupBy("key", "id", "h").agg(F.any_value("leaf").alias("leaf"), F.any_value("masked").alias("masked"), F.count(F.lit(1)).alias("rows"))
    forms = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.any_value("leaf").alias("leaf"), F.any_value("masked").alias("masked"))
    return materialise(forms, "forms")


def _of_common_templates(found: DataFrame, templates: DataFrame, forms: DataFrame, min_docs: int) -> DataFrame:
    """id, h, place, template of the lines of ``found`` whose template ``min_docs`` documents have.

    Lines and templates that very many rows have are broadcast instead of joined by key, so no task gets all of one.
    """
    total = found.count()
    templates = materialise(templates.join(forms.select("key", "rows"), "key"), "templates")
    seen = join_groups(found.select("id", "h", "place", "key"), templates, "key", "rows", total).select("id", "h", "place", "tkey", "template")
    seen = materialise(seen, "seen")
    each = seen.groupBy("tkey", "id", "h").agg(F.count(F.lit(1)).alias("rows"))
    often = each.groupBy("tkey").agg(F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("rows")).where(F.col("docs") >= min_docs)
    often = materialise(often.select("tkey", "rows"), "common-templates")
    return join_groups(seen, often, "tkey", "rows", total).select("id", "h", "place", "template")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """id, h, place, template of the lines that go. ``docs`` has id, h and text without nulls in text."""
    lines = _lines(docs)
    leaves = lines.groupBy("leaf", "id", "h").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    leaves = materialise(leaves, "leaves")
    found = lines.join(F.broadcast(leaves), "leaf") if leaves.count() <= BROADCAST_LEAVES else lines.join(leaves, "leaf")
    found = found.withColumn("masked", F.regexp_replace("plain", VARIABLE, WILDCARD))
    found = materialise(found.select("id", "h", "place", "leaf", "masked", _name(F.hex("leaf"), F.col("masked")).alias("key")), "lines")
    forms = _forms(found)
    tokens = forms.select("key", "leaf", "n", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    support = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("support")).where((F.col("support") >= min_docs) & (F.col("token") != WILDCARD))
    kept = tokens.join(support, ["leaf", "at", "token"], "left")
    stays = F.col("support").isNotNull()
    # A line's tokens are one row each here; they meet again by the line's key.
    whole = kept.groupBy("key", "leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(stays, F.col("token")).otherwise(F.lit(WILDCARD)).alias("t")))), lambda x: x["t"]), " ").alias("template"), F.avg(stays.cast("double")).alias("share"))
    templates = whole.where(F.col("share") >= similarity).select("key", _name(F.hex("leaf"), F.col("template")).alias("tkey"), "template")
    return _of_common_templates(found, templates, forms, min_docs)


def relative_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """As dropped_lines, but what stays is decided relative to the line, so it doesn't depend on how much data there is.

    A line's tokens are ordered by how many (document, line) pairs have them at their place. Those as frequent as the
    least of the most frequent ``similarity`` of them stay, and rarer ones are variable fields: in every line of a
    template the constant tokens are at least as frequent as the template is, and a field's values are rarer. Masked
    digits are tokens like others here, and a line that ``min_docs`` documents have, apart from digits, always goes.
    A line may come twice. What may stay: a line whose field holds, by chance, a token that is frequent at that place.
    """
    found = _candidates(docs, min_docs)
    forms = _forms(found)
    tokens = forms.select("key", "leaf", F.col("n"), F.posexplode(F.split("masked", " ")).alias("at", "token"))
    support = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs)
    kept = tokens.join(support, ["leaf", "at", "token"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    whole = kept.groupBy("key", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "token", "support"))).alias("t"))
    # The tokens that need not stay, without the error of a product of floats.
    spare = (F.size("t") - F.ceil(F.size("t") * F.lit(similarity) - 1e-9)).cast("int")
    whole = whole.withColumn("least", F.get(F.array_sort(F.transform("t", lambda x: x["support"])), spare)).where(F.col("least") >= min_docs)
    whole = whole.withColumn("t", F.transform("t", lambda x: F.when(x["support"] >= F.col("least"), x["token"]).otherwise(F.lit(WILDCARD))))
    templates = whole.where(F.exists("t", lambda x: x != WILDCARD)).select("key", _name(F.col("leaf"), F.array_join("t", " ")).alias("tkey"), F.array_join("t", " ").alias("template"))
    out = _of_common_templates(found, templates, forms, min_docs)
    # Repeats of a masked line go whatever its template is.
    repeats = forms.where(F.col("n") >= min_docs).select("key", "rows", F.col("masked").alias("template"))
    same = join_groups(found.select("id", "h", "place", "key"), repeats, "key", "rows", found.count())
    return out.unionByName(same.select("id", "h", "place", "template"))


def _candidates(docs: DataFrame, min_docs: int) -> DataFrame:
    """id, h, place, leaf, masked, key of the lines one of whose paths min_docs documents reach; a leaf is a token count.

    Lines of digits only are their own masks: they have no words that a template could keep.
    """
    rows = docs.select("id", "h", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("plain", _plain(F.col("line"))).where("plain <> ''")
    lines = rows.select("id", "h", "place", "plain", _paths(F.col("plain")).alias("paths"))
    each = lines.select("id", "h", "place", F.explode(F.array_distinct("paths")).alias("path"))
    often = each.groupBy("path", "id", "h").agg(F.lit(1).alias("one")).groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("path")
    often = materialise(often, "paths")
    if often.count() <= BROADCAST_LEAVES:
        found = lines
        for i in range(WINDOWS):
            found = found.join(F.broadcast(often.select(F.col("path").alias(f"p{i}"))), F.col("paths")[i] == F.col(f"p{i}"), "left")
        found = found.where(F.coalesce(*[f"p{i}" for i in range(WINDOWS)]).isNotNull())
    else:  # equal texts have equal lines, so the text's hash names a line as well as its document does
        found = lines.join(each.join(often, "path").select("h", "place").distinct(), ["h", "place"])
    masked = F.regexp_replace("plain", VARIABLE, WILDCARD)
    words = F.replace(F.replace(masked, F.lit(WILDCARD), F.lit("")), F.lit(" "), F.lit("")) != ""
    found = found.select("id", "h", "place", F.size(F.split("plain", " ")).alias("leaf"), F.when(words, masked).otherwise(F.col("plain")).alias("masked"))
    return materialise(found.withColumn("key", _name(F.col("masked"))), "lines")


def _paths(plain: Column) -> Column:
    """Four ways down the tree: the token count with one to three tokens from each quarter of the line."""

    def path(t: Column, i: int) -> Column:
        n = F.size(t)
        width = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(n / 4).cast("int")))
        window = F.array_join(F.slice(t, F.floor(n * i / WINDOWS).cast("int") + 1, width), " ")
        return _name(F.lit(i), n, F.regexp_replace(window, VARIABLE, WILDCARD))

    # A function's argument is computed once, the paths of it are not.
    return F.transform(F.array(F.split(plain, " ")), lambda t: F.array(*[path(t, i) for i in range(WINDOWS)]))[0]


def deduplicate(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = dropped_lines) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is left, lines joined by \\n) of every row; ``find`` names the lines that go."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    gone = find(rows, min_docs, similarity).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("place").alias("gone"))
    gone = materialise(gone, "gone")
    out = rows.join(gone.hint("merge"), (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    lines = F.split("text", "\n")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return out.select(F.col("id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), left.alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(deduplicate(table(spark, sf_dir, "documents")))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(deduplicate(table(spark, sf_dir, "documents"), find=relative_lines))


def _summary(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup, "op3_line_templates": op3_line_templates}
ORACLE = {
    "op3_line_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
        p AS (SELECT doc_id, place, line, string_split(trim(translate(line, chr(9) || chr(13), '  '), ' '), ' ') AS t FROM l WHERE trim(translate(line, chr(9) || chr(13), '  '), ' ') <> ''),
        m AS (SELECT doc_id, place, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM p),
        f AS (SELECT *, concat(len(t), ' ', array_to_string(t[1:3], ' ')) AS leaf, array_to_string(t, ' ') AS masked FROM m),
        g AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5),
        c AS (SELECT f.* FROM f JOIN g USING (leaf)),
        e AS (SELECT masked, leaf, any_value(t) AS t, count(DISTINCT doc_id) AS n FROM c GROUP BY masked, leaf),
        k AS (SELECT masked, leaf, n, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM e),
        s AS (SELECT *, sum(n) OVER (PARTITION BY leaf, pos, token) >= 5 AND token <> '<*>' AS stays FROM k),
        w AS (SELECT masked, leaf, string_agg(CASE WHEN stays THEN token ELSE '<*>' END, ' ' ORDER BY pos) AS template, avg(stays::int) AS share FROM s GROUP BY masked, leaf),
        o AS (SELECT c.doc_id, c.place, leaf, template FROM c JOIN w USING (masked, leaf) WHERE share >= 0.7),
        r AS (SELECT leaf, template FROM o GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 5),
        x AS (SELECT doc_id, place FROM o JOIN r USING (leaf, template)),
        z AS (SELECT l.doc_id, count(*) AS n_lines, count(x.place) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.place) FILTER (x.place IS NULL), '') AS kept
              FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.place = l.place GROUP BY l.doc_id)
        SELECT doc_id, n_lines, n_dropped, length(kept) AS n_chars, sha256(kept) AS kept_sha256 FROM z
    """
}
