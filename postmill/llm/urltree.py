"""Verdicts for urls: fixed host and path rules first, then a tree of path templates judged by labelled purity.

All steps are DataFrame expressions. Per host, a path is cut into segments; segments that vary become `*`:

1. by shape: numbers (with or without a file ending), long hexadecimal words, dates;
2. by statistics, from the top down: under one host and the template above, a position with many different words that few
   distinct paths share.

Templates of one host that differ in one literal segment are branches of the same parent. A branch whose share of good
labels does not differ from its parent's (two-proportion z-test) is judged by the parent's counts, others by their own.
A template is rejected when its smoothed purity, (good + strength * prior) / (labelled + strength), is under `least`.

Defined cases: a null url, or one without `://`, has an empty host and an empty path, fits no rule and belongs to a
template of its own that is judged like any other; repeated rows count as often as they occur for purity and not at all for
templates; rows without a label are judged but do not count; an empty table gives no rows; with no labels at all the prior is 1 and nothing is rejected.
Hosts and paths of any
length are returned whole.
"""

from pyspark.sql import DataFrame, functions as F

from postmill.llm.registry import query, table
from postmill.operators.spread import attach
from postmill.session import written

#: (action, host, path): a rule fits the host and its subdomains when the url's path starts with the rule's path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A position is variable from so many different words on, if a word has less than REPEATS distinct paths on average.
VARIANTS = 8
REPEATS = 4.0
#: A branch joins its parent while its share of good labels is within this many standard errors.
Z = 1.96
#: Weight of the overall share of good labels, in labelled pages, and the least accepted purity.
STRENGTH = 10.0
LEAST = 0.8
#: Depth of the tree: the segments below count as one node.
DEPTH = 16
VARIABLE = r"^(\d+([-_.]\d+)*(\.\w{1,5})?|[0-9a-f]{8,}([-][0-9a-f]{4,})*|\d{4}-\d{2}-\d{2}.*)$"


def host_and_path(url):
    """Columns for the host (A-Z in lower case) and the path of a url column."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host, path, rules=RULES):
    """Columns for the text of the longest rule that fits and its action, both null where none fits."""
    text = action = F.lit(None).cast("string")
    for act, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = F.startswith(path, F.lit(own_path)) & F.endswith(F.concat(F.lit("."), host), F.lit(f".{own_host}"))
        text = F.when(fits, own_host + own_path).otherwise(text)
        action = F.when(fits, act).otherwise(action)
    return text, action


def templates(pages: DataFrame, variants=VARIANTS, repeats=REPEATS) -> DataFrame:
    """One row per (host, path) of the pages, with its template and its parent.

    Pages are reduced to distinct paths before anything else, so neither a hot page nor pages that occur again count more.
    The tree is gone down level by level: the words at a position are counted under the template of what is above, with
    variable positions already generalised. Each level is written, so a lost executor costs one level.
    """
    segments = F.split("path", "/", DEPTH + 1)
    shape = F.transform(segments, lambda s, i: F.when((i == DEPTH) | F.rlike(s, F.lit(VARIABLE)), "*").otherwise(s))
    rows = written(pages.select("host", "path").distinct().select(
        "host", "path", shape.alias("shape"), F.lit("").alias("template"), F.lit("").alias("parent")), "url-tree")
    deepest = rows.agg(F.max(F.size("shape"))).first()[0] or 0  # at most DEPTH + 1
    for at in range(deepest):
        word, here = F.get("shape", F.lit(at)), F.size("shape") > at
        words = rows.where(here & ~word.isin("", "*")).groupBy("host", "template", word.alias("word")).agg(F.count("*").alias("n"))
        varied = words.groupBy("host", "template").agg(F.count("*").alias("words"), F.sum("n").alias("n")).where(
            (F.col("words") >= variants) & (F.col("n") < F.col("words") * repeats)).select(
            "host", "template", F.lit(True).alias("varied"))
        own = F.when((word != "") & F.col("varied"), "*").otherwise(word)
        between = F.lit("/" if at else "")
        template = F.concat("template", between, own)
        # The parent has a plus sign for the last literal word.
        parent = F.when(own.isin("", "*"), F.concat("parent", between, own)).otherwise(F.concat("template", between, F.lit("+")))
        rows = written(attach(rows, varied, ["host", "template"]).select(
            "host", "path", "shape", F.when(here, template).otherwise(F.col("template")).alias("template"),
            F.when(here, parent).otherwise(F.col("parent")).alias("parent")), "url-tree")
    return rows.select("host", "path", "template", "parent")


def template_verdicts(labelled: DataFrame, z=Z, strength=STRENGTH, least=LEAST) -> DataFrame:
    """(host, template, verdict) from rows (host, template, parent, good); good is 1, 0 or null."""
    own = labelled.groupBy("host", "template", "parent").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    above = own.groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("g").alias("pg"))
    # One row: the share of good labels over all pages.
    prior = own.agg(F.coalesce(F.try_divide(F.sum("g"), F.sum("n")), F.lit(1.0)).alias("prior"))
    both = own.join(above, ["host", "parent"]).withColumn("prior", prior.scalar())
    pooled = F.col("pg") / F.greatest("pn", F.lit(1))
    error = F.sqrt(pooled * (1 - pooled) / F.greatest("n", F.lit(1)))
    alike = (F.col("n") == 0) | (F.abs(F.col("g") / F.greatest("n", F.lit(1)) - pooled) <= z * error)
    purity = F.when(alike, (F.col("pg") + strength * F.col("prior")) / (F.col("pn") + strength)).otherwise(
        (F.col("g") + strength * F.col("prior")) / (F.col("n") + strength))
    return both.select("host", "template", F.when(purity < least, "block").otherwise("allow").alias("judged"))


def judge(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """Verdicts for rows (page_id, url, good): adds host, path, rule, template and verdict, drops good."""
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    text, action = matching_rule(F.col("host"), F.col("path"), rules)
    tree = templates(rows, **{k: v for k, v in options.items() if k in ("variants", "repeats")})
    placed = rows.join(tree, ["host", "path"])
    judged = template_verdicts(placed, **{k: v for k, v in options.items() if k in ("z", "strength", "least")})
    return placed.join(judged, ["host", "template"]).withColumns({"rule": text, "action": action}).select(
        "page_id", "host", "path", "rule", F.coalesce("action", "judged").alias("verdict"), "template", "url")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with the quality label of the document that the last number of their path names."""
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"(\d{1,18})(\.\w+)?/?$", 1)
    marks = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.col("quality").cast("long")).alias("good"))
    return pages.select("page_id", "url", F.when(number != "", number.cast("long")).alias("_doc")).join(
        marks, "_doc", "left").select("page_id", "url", "good")


def _level(i):
    """SQL of one level: which positions vary under what is above, and the templates one segment longer."""
    between = "'/' || " if i > 1 else ""
    return f"""varied{i} AS MATERIALIZED (SELECT host, template FROM (
    SELECT host, template, shape[{i}] AS word, count(*) AS n FROM level{i - 1}
    WHERE len(shape) >= {i} AND shape[{i}] NOT IN ('', '*') GROUP BY ALL)
  GROUP BY ALL HAVING count(*) >= 8 AND sum(n) < count(*) * 4.0),
level{i} AS MATERIALIZED (
  SELECT host, path, shape, CASE WHEN w IS NULL THEN template ELSE template || {between}w END AS template,
    CASE WHEN w IS NULL THEN parent WHEN w IN ('', '*') THEN parent || {between}w ELSE template || {between}'+' END AS parent
  FROM (SELECT l.*, CASE WHEN l.shape[{i}] <> '' AND v.host IS NOT NULL THEN '*' ELSE l.shape[{i}] END AS w
    FROM level{i - 1} l LEFT JOIN varied{i} v ON v.host = l.host AND v.template = l.template)),
"""


SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows0 AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
marks AS (SELECT doc_id, max(CAST(quality AS BIGINT)) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
r AS (
  SELECT p.*, m.good FROM rows0 p LEFT JOIN marks m
  ON m.doc_id = TRY_CAST(regexp_extract(p.path, '(\d{1,18})(\.\w+)?/?$', 1) AS BIGINT)),
level0 AS MATERIALIZED (
  SELECT host, path, '' AS template, '' AS parent, list_transform(string_split(path, '/')[1:17], lambda s, i: CASE WHEN i = 17
    OR regexp_matches(s, '^(\d+([-_.]\d+)*(\.\w{1,5})?|[0-9a-f]{8,}([-][0-9a-f]{4,})*|\d{4}-\d{2}-\d{2}.*)$') THEN '*' ELSE s END)
    AS shape FROM (SELECT DISTINCT host, path FROM r)),
LEVELS
tree AS (SELECT host, path, template, parent FROM level17),
placed AS (SELECT r.*, t.template, t.parent FROM r JOIN tree t ON t.host = r.host AND t.path = r.path),
own AS (SELECT host, template, parent, count(good) AS n, coalesce(sum(good), 0) AS g FROM placed GROUP BY ALL),
above AS (SELECT host, parent, sum(n) AS pn, sum(g) AS pg FROM own GROUP BY ALL),
prior AS (SELECT coalesce(sum(g) / nullif(sum(n), 0), 1.0) AS prior FROM own),
stats AS (
  SELECT o.host, o.template, o.n, o.g, pn, pg, prior, pg / greatest(pn, 1) AS pooled
  FROM own o JOIN above a ON a.host = o.host AND a.parent = o.parent CROSS JOIN prior),
judged AS (
  SELECT host, template, CASE WHEN CASE
      WHEN n = 0 OR abs(g / greatest(n, 1) - pooled) <= 1.96 * sqrt(pooled * (1 - pooled) / greatest(n, 1))
      THEN (pg + 10.0 * prior) / (pn + 10.0) ELSE (g + 10.0 * prior) / (n + 10.0) END < 0.8
    THEN 'block' ELSE 'allow' END AS judged FROM stats),
ruled AS (
  SELECT p.page_id, p.host, p.path, p.template, CASE
    WHEN ends_with('.' || p.host, '.www.example.com') AND starts_with(p.path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || p.host, '.example.com') AND starts_with(p.path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || p.host, '.net') AND starts_with(p.path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || p.host, '.net') AND starts_with(p.path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || p.host, '.com') AND starts_with(p.path, '/') THEN 'com/' END AS rule FROM placed p)
SELECT u.page_id, u.host, u.path, u.rule, CASE WHEN u.rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN u.rule IS NOT NULL THEN 'block' ELSE j.judged END AS verdict
FROM ruled u JOIN judged j ON j.host = u.host AND j.template = u.template
""".replace("LEVELS", "".join(_level(i) for i in range(1, DEPTH + 2)))


@query("op8_url_filter", SQL)
def op8(spark, sf_dir):
    """Judges every page's url; labels come from the documents that the urls name."""
    rows = labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judge(rows).select("page_id", "host", "path", "rule", "verdict")
