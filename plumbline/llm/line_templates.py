"""Line dedup (7) by a log-template tree, in DataFrame operations only.

A line's tokens are its runs between blanks; a token with a digit is a variable field. A line of which more than
half are such fields has no fixed words to tell it by: it is compared as it stands and only equal ones are of one
template. The tree has a fixed depth: any other line goes to its leaf by the number of tokens and the first ``LEADING`` of
them. In a leaf two lines are of one template if at least ``SIMILAR`` of their tokens are equal, place by place,
directly or through other lines of the leaf; where lines of a template differ is a variable field. So a leaf holds
any number of templates, their fields grow with the lines that join, and lines of no template change nothing for
others. A template that occurs in more than one document stays in the first of them and is dropped from the others.

Lines travel as 128-bit hashes: recurring ones fold into one row before they are shuffled, and only lines of leaves
that hold several different ones of several documents are fetched, picked inside their document's row. Alike lines
meet under keys that any two of them share (``_keys``), so a leaf is never gathered nor are its pairs made: under a
key lines are compared with a leader, and those that are not connected by then with the next leaders. Text is shuffled
twice, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import by_core, cut, own_names, table
from plumbline.llm.graph import components, further

LEADING = 3
#: The share of equal tokens, as a fraction.
SIMILAR = (4, 5)
#: Lines of fewer tokens recur by chance and stay.
LEAST_TOKENS = 5
FIELD = "<*>"
BLANKS = "[ \\t\\r\\f\\x0b]+"
WITH_DIGIT = "[^ \\t\\r\\f\\x0b0-9]*+[0-9][^ \\t\\r\\f\\x0b]*+"


def normal(line: Column) -> Column:
    """A line's tokens with single blanks between, fields masked unless they are more than half."""
    plain = ~(line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\f") | line.contains("\x0b") | line.startswith(" ") | line.endswith(" "))
    single = F.when(plain, line).otherwise(F.trim(F.regexp_replace(line, BLANKS, " ")))
    masked = F.regexp_replace(single, WITH_DIGIT, FIELD)
    fields = (F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(FIELD), F.lit("")))) / len(FIELD)
    return F.when(~line.rlike("[0-9]"), single).when(fields * 2 > n_tokens(masked), single).otherwise(masked)


def n_tokens(normal: Column) -> Column:
    """The tokens of a normal line; 1 for a blank one."""
    return F.octet_length(normal) - F.octet_length(F.replace(normal, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, ln, leaf, h1, h2) of every line that may be dropped; th tells texts of one doc_id apart.

    leaf is null for lines that only equal ones may join: they alone still hold a digit.
    """
    doc = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), F.posexplode_outer(F.split("text", "\n")).alias("ln", "line"))
    # as an output of explode the normal line is computed once, for the filter and the hashes
    each = doc.select("doc", "th", "ln", F.explode_outer(F.array(normal(F.col("line")))).alias("x"))
    x = F.col("x")
    each = each.where(n_tokens(x) >= LEAST_TOKENS)
    leaf = F.when(~x.rlike("[0-9]"), F.xxhash64(n_tokens(x), F.substring_index(x, " ", LEADING)))
    return each.select("doc", "th", "ln", leaf.alias("leaf"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, leaf, h1, h2, first, last, t): the tokens of the variants ``wanted``."""
    by_doc = wanted.groupBy(F.col("first.doc").alias("d"), F.col("first.th").alias("dth")).agg(F.collect_list(F.struct("leaf", "h1", "h2", "first", "last")).alias("w"))
    source = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    met = by_doc.join(source, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("dth") == F.col("th")))
    # as an output of explode the split text is one array a document; a picked line doesn't carry the text along
    split = met.select("w", F.explode_outer(F.array(F.split("text", "\n"))).alias("lines"))
    picked = split.select(F.explode(F.transform("w", lambda x: F.struct(x.alias("v"), F.get(F.col("lines"), x["first"]["ln"]).alias("line")))).alias("p"))
    # a row that repeats gives its lines again
    out = picked.select("p.v.*", F.split(normal(F.col("p.line")), " ").alias("t")).dropDuplicates(["h1", "h2"])
    return cut(out.withColumn("id", F.monotonically_increasing_id()), "tokens")


def _keys(n: Column, t: Column) -> Column:
    """Hashes of which two alike lines of a leaf share one at least.

    Of n tokens d = n / 5 may differ, none of them leading. If d is 1, a key leaves out one token. Else the tokens
    behind the leading ones are dealt to blocks: to d + 2 of which two must agree, up to d = 3, beyond to d + 1 of which
    one must.
    """
    d = F.floor(n * (SIMILAR[1] - SIMILAR[0]) / SIMILAR[1]).cast("int")
    rest = n - LEADING
    start = lambda i, of: (F.floor(i * rest / of) + LEADING + 1).cast("int")
    block = lambda i, of: F.slice(t, start(i, of), start(i + 1, of) - start(i, of))
    but_one = F.transform(F.sequence(F.lit(LEADING + 1), n), lambda i: F.xxhash64(i, F.concat(F.slice(t, F.lit(1), i - 1), F.slice(t, i + 1, n - i))))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), d), lambda i: F.transform(F.sequence(i + 1, d + 1), lambda j: F.xxhash64(i, j, block(i, d + 2), block(j, d + 2)))))
    one = F.transform(F.sequence(F.lit(0), d), lambda i: F.xxhash64(i, block(i, d + 1)))
    return F.when(d <= 1, but_one).when(d <= 3, pairs).otherwise(one)


def _alike(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (u, v and more) whose lines are alike; leaves and lengths are compared too, not only their hashes."""
    rows = pairs.join(tokens.select(F.col("id").alias("u"), F.col("t").alias("s")), "u").join(tokens.select(F.col("id").alias("v"), "t"), "v")
    equal = F.aggregate(F.zip_with("t", "s", lambda a, b: a.eqNullSafe(b).cast("int")), F.lit(0), lambda n, x: n + x)
    same = (F.size("t") == F.size("s")) & (F.slice("t", 1, LEADING) == F.slice("s", 1, LEADING))
    return rows.where(same & (equal * SIMILAR[1] >= F.size("t") * SIMILAR[0])).select(*pairs.columns)


def _joined(tokens: DataFrame) -> DataFrame:
    """(node, root): which of the lines hang together; lines like no other are absent."""
    keys = tokens.select("id", F.explode(_keys(F.size("t"), F.col("t"))).alias("k"), "leaf").select("id", F.xxhash64("leaf", "k").alias("k"))
    keys = cut(by_core(keys.distinct()), "keys")
    leads = cut(by_core(keys.groupBy("k").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1").select("k", "lead")), "leads")
    left = cut(by_core(keys.join(leads, "k").where("id <> lead")), "left")
    roots = components(cut(_alike(left.select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct(), tokens), "alike"))
    left, many = left.select("k", "id"), 1
    while True:
        named = left.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        split = cut(by_core(named.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k")), "split")
        left = cut(by_core(named.join(split, "k")), "left")
        if left.isEmpty():
            return roots
        many *= 4
        placed = cut(left.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("id"))), "placed")
        ahead = placed.where(F.col("place") <= many).select("k", F.col("id").alias("u"), F.col("root").alias("ru"), F.col("place").alias("ahead"))
        pairs = placed.join(ahead, "k").where("place > ahead and root <> ru").select("u", F.col("id").alias("v"), "ru", F.col("root").alias("rv")).distinct()
        new = cut(_alike(pairs, tokens).select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "alike")
        left = placed.where(F.col("place") > many).select("k", "id")
        if not new.isEmpty():
            roots = further(roots, new)


def recurring(docs: DataFrame) -> DataFrame:
    """(doc, th, ln): the lines to drop; ``docs`` has doc_id and text."""
    lines = cut(_lines(docs), "lines")
    variants = lines.groupBy("h1", "h2").agg(F.min("leaf").alias("leaf"), F.min(F.struct("doc", "ln", "th")).alias("first"), F.max("doc").alias("last"))
    variants = cut(by_core(variants), "variants")
    several = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("first.doc"))
    leaves = variants.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.min("first.doc").alias("low"), F.max("last").alias("last"), F.count_if(F.col("first.doc").isNull()).alias("none"))
    # as a table of its own, so that Spark can split a leaf with very many lines when it joins
    leaves = cut(by_core(leaves.where((F.col("n") > 1) & F.col("last").isNotNull() & ((F.col("none") > 0) | (F.col("low") < F.col("last")))).select("leaf")), "leaves")
    tokens = _fetched(docs, variants.join(leaves, "leaf"))
    roots = _joined(tokens)
    named = cut(by_core(tokens.select("id", "h1", "h2", "first", "last").join(roots.withColumnRenamed("node", "id"), "id")), "named")
    grown = named.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last")).where(several).select("root", F.col("first.doc").alias("owner"))
    alone = variants.where(several).join(named.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", F.col("first.doc").alias("owner"))
    kept = cut(by_core(alone.unionByName(named.join(cut(by_core(grown), "owners"), "root").select("h1", "h2", "owner"))), "kept")
    return lines.join(kept, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("owner"))).select("doc", "th", "ln")


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines out of ``text``, and n_lines and n_dropped appended (replacing such columns).

    What is left of a text stays as it was, its line breaks included. A null text stays null (no lines), blank
    lines and lines of fewer than ``LEAST_TOKENS`` tokens stay. Rows of one doc_id, a null one too, are one
    document: their lines do not recur across documents by themselves. Repeated rows stay repeated; an empty
    table gives no rows. Any other column may have any name. A very long text is one row; its lines are compared
    whole, however long, and memory follows the longest text.
    """
    docs = docs.drop("n_lines", "n_dropped")
    doc, th, gone, lines, size = own_names(docs, "doc", "th", "gone", "lines", "size")
    drops = recurring(docs.select("doc_id", "text")).groupBy(F.col("doc").alias(doc), F.col("th").alias(th)).agg(F.collect_set("ln").alias(gone))
    drops = cut(by_core(drops), "drops")
    met = docs.join(drops, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(th)), "left")
    met = met.select(*[met[c] for c in docs.columns], gone, F.explode_outer(F.array(F.split("text", "\n"))).alias(lines))
    met = met.withColumn(size, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
    stay = F.array_except(F.sequence(F.lit(0), F.col(size) - 1), gone)
    new = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return met.select(*[(new if c == "text" else met[f"`{c.replace('`', '``')}`"]).alias(c) for c in docs.columns], F.col(size).alias("n_lines"), F.greatest(F.size(gone), F.lit(0)).alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: each document's lines and dropped lines, with a digest of the text that is left."""
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.char_length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


ORACLE = f"""
WITH RECURSIVE lines AS (
  SELECT d.doc_id, u.i - 1 AS ln, u.line AS line, trim(regexp_replace(u.line, '[ \\t\\r\\f\\x0b]+', ' ', 'g')) AS raw
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) u
), masks AS (
  SELECT *, string_split(regexp_replace(raw, '[^ 0-9]*[0-9][^ ]*', '{FIELD}', 'g'), ' ') AS m FROM lines
), each AS (
  SELECT doc_id, ln, len(m) AS n, CASE WHEN len(list_filter(m, lambda x: x = '{FIELD}')) * 2 > len(m) THEN string_split(raw, ' ') ELSE m END AS t
  FROM masks WHERE len(m) >= {LEAST_TOKENS}
), variants AS (
  SELECT n, t, min(doc_id * 1000000 + ln) AS id, NOT regexp_matches(array_to_string(t, ' '), '[0-9]') AS open FROM each GROUP BY n, t
), edges AS (
  SELECT a.id AS u, b.id AS v FROM variants a JOIN variants b ON a.n = b.n AND a.t[1:{LEADING}] = b.t[1:{LEADING}]
  WHERE a.id <> b.id AND a.open AND b.open AND {SIMILAR[1]} * len(list_filter(range(1, a.n + 1), lambda i: a.t[i] = b.t[i])) >= {SIMILAR[0]} * a.n
), reach AS (
  SELECT id AS a, id AS b FROM variants UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u
), named AS (
  SELECT v.t, r.template FROM variants v JOIN (SELECT a, min(b) AS template FROM reach GROUP BY a) r ON v.id = r.a
), placed AS (
  SELECT e.doc_id, e.ln, m.template FROM each e JOIN named m ON e.t = m.t
), owners AS (
  SELECT template, min(doc_id) AS owner, count(DISTINCT doc_id) AS docs FROM placed GROUP BY template
), dropped AS (
  SELECT p.doc_id, p.ln FROM placed p JOIN owners o ON p.template = o.template WHERE o.docs > 1 AND p.doc_id <> o.owner
), marked AS (
  SELECT l.doc_id, l.ln, l.line, d.ln IS NOT NULL AS gone FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.ln = d.ln
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(x.n_lines, 0)::BIGINT AS n_lines, coalesce(x.n_dropped, 0)::BIGINT AS n_dropped,
       length(x.kept)::BIGINT AS n_chars_left, md5(x.kept) AS text_md5
FROM documents d LEFT JOIN done x ON d.doc_id = x.doc_id
"""
