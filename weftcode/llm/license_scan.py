"""License scan, in DataFrame operations only.

1. Units of a file: each line, each line joined with the next one (headers are wrapped), each paragraph (lines between
   blank ones), anywhere in its text, and the whole text of a file whose name says that it is a licence. Equal units are scored once.
2. Sparse TF-IDF vectors of units and templates, and their cosine; the best template at ``MIN_SCORE`` or
   more is the unit's licence, the best unit's licence the file's. The weight of a term that occurs n times is (1 + ln n) idf,
   idf = ln(1 + N / (1 + df)), with N files and df of them that have the term. Terms of no template weigh
   as if no file had them: they only make a unit less like any template. What SPDX identifiers name is a licence of score 1.
   A unit that says that something is not released (licensed, ...) under a licence names none.
3. A directory's licence is that of its best licence file. A file without a licence of its own
   gets that of the nearest directory above it: the distinct directories are
   joined to their ancestors' licences by path, then the files to their directories.

Most units are never scored, and none that could reach ``MIN_SCORE`` is left out: of each template, its lightest terms
that together have less than ``MIN_SCORE`` of its norm are set aside. A unit that shares none of the other
terms has, by Cauchy and Schwarz, a cosine below ``MIN_SCORE``. So files, then lines, are looked through for the other terms ("keys").

Only what templates have (their terms, counts and weights) is broadcast or sent to the driver.

Defined results: null or empty texts have no units. Files with a null path have no directory and can't be
told apart, so they keep ``license`` null. Rows that repeat a path are one file: each gets what all of their
units together say. Equal scores go to the template first in the alphabet, and of equal licence files to the
path first in order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, load, small_table
from .license_texts import TEMPLATES

LICENSE_FILE = r"(?i)^(un)?licen[cs]e([-._].*)?$|^copying([-._].*)?$"
#: A text of which lines with one of these words make up half is a licence file of the query's virtual tree.
FILE_WORDS = r"(?i)licen[cs]e|copyright|public domain"
TERM = r"[a-zA-Z0-9]+(?:[.-][a-zA-Z0-9]+)*"
BLANK = r"\n[\x20\x09-\x0D]*\n"
NEGATED = (
    r"(?i)(?:^|[^a-zA-Z0-9_])(?:not|never|no longer)[\x20\x09-\x0D]+(?:[a-zA-Z]+[\x20\x09-\x0D]+){0,2}"
    r"(?:released|licensed|distributed|available|published|provided|offered)[\x20\x09-\x0D]+(?:[a-zA-Z]+[\x20\x09-\x0D]+)?under(?:$|[^a-zA-Z0-9_])"
)
SPDX = "spdx-license-identifier"
SPDX_ID = r"(?i)(?:^|[^a-zA-Z0-9.-])spdx-license-identifier:[\x20\x09(]*([a-zA-Z0-9.+-]+)"
SPDX_LATER = r"(?i)(?:-only|-or-later|\+)$"
MIN_SCORE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text):
    """Array of the terms of a text column, in lower case (they are ASCII; a whole text is not folded)."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def words_literal(words):
    """An array of these words, which have no spaces, as one literal."""
    return F.split(F.lit(" ".join(sorted(words))), " ")


def directory(path):
    """Path up to its last slash; the empty path for none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def template_rows(spark, templates) -> DataFrame:
    """(template, license, term, tf) of all templates."""
    rows = small_table(spark, [(i, k, text) for i, (k, text) in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


class Model:
    """Weights of the templates' terms over a corpus of files (path, text), from one pass over all texts."""

    def __init__(self, files: DataFrame, templates=TEMPLATES):
        spark = files.sparkSession
        counted = template_rows(spark, templates).collect()  # what the templates have, whatever the files
        vocabulary = words_literal({r.term for r in counted})
        found = F.array_intersect(terms_of(F.coalesce("text", F.lit(""))), vocabulary)
        seen = files.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        df = {r.term: r.n for r in seen.collect()}  # a row for each term of the templates, and one for all files
        total = df.get("", 0)
        self.unseen = math.log(1 + total)
        self.idf = {r.term: math.log(1 + total / (1 + df.get(r.term, 0))) for r in counted}
        vectors = defaultdict(dict)
        for r in counted:
            vectors[r.template, r.license][r.term] = (1 + math.log(r.tf)) * self.idf[r.term]
        self.norms = {k: math.sqrt(sum(sorted(v * v for v in t.values()))) for k, t in vectors.items()}
        self.keys: set[str] = set()
        for k, t in vectors.items():
            left = ((MIN_SCORE - 1e-5) * self.norms[k]) ** 2
            for v, term in sorted((v, term) for term, v in t.items()):
                left -= v * v
                if left <= 0:
                    self.keys.add(term)
        rows = [(k[0], k[1], term, v, self.norms[k]) for k, t in vectors.items() for term, v in t.items()]
        self.weights = small_table(spark, rows, "template int, license string, term string, v double, nv double")
        self.terms = small_table(spark, sorted(self.idf.items()), "term string, idf double")


def units_of(files: DataFrame, keys: set[str]) -> DataFrame:
    """(path, unit, spdx) of the files (path, text) that may have a licence; of those units that share a key, or name an SPDX id."""
    key = words_literal(keys)
    keyed = lambda x: F.arrays_overlap(terms_of(x), key)
    files = files.filter(F.arrays_overlap(terms_of(F.col("text")), words_literal(keys | {SPDX}))).filter("path is not null")
    files = files.select("path", "text", F.split("text", "\n").alias("lines"))
    files = files.withColumn("hit", F.transform("lines", keyed))
    at = lambda c, i: F.get(c, i)
    one = F.filter("lines", lambda x, i: at("hit", i))
    two = F.transform(F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: at("hit", i - 1) | F.coalesce(at("hit", i), F.lit(False))), lambda i: F.concat_ws(" ", at("lines", i - 1), at("lines", i)))
    paragraphs = F.filter(F.split("text", BLANK), keyed)
    plain = F.filter(F.concat(one, two, paragraphs), lambda x: ~x.rlike(NEGATED))
    whole = F.when(basename(F.col("path")).rlike(LICENSE_FILE), F.array("text")).otherwise(F.array())
    ids = F.transform("lines", lambda x: F.regexp_replace(F.regexp_extract(x, SPDX_ID, 1), SPDX_LATER, ""))
    unit = lambda x, s: F.struct(x.alias("unit"), s.alias("spdx"))
    both = F.concat(
        F.transform(F.array_distinct(F.concat(plain, whole)), lambda x: unit(x, F.lit(None).cast("string"))),
        F.transform(F.filter(F.array_distinct(ids), lambda x: x != ""), lambda x: unit(F.lit(None).cast("string"), x)),
    )
    return files.select("path", F.explode(both).alias("u")).select("path", "u.unit", "u.spdx")


def score_units(units: DataFrame, model: Model) -> DataFrame:
    """(uid, license, score) of each distinct unit that is like a template. units: uid, unit."""
    distinct = units.groupBy("uid").agg(F.first("unit").alias("unit"))
    tf = distinct.select("uid", F.explode(terms_of(F.col("unit"))).alias("term")).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(model.unseen))
    weighted = tf.join(F.broadcast(model.terms), "term", "left").select("uid", "term", weight.alias("w"))
    norm = weighted.groupBy("uid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nw"))
    dots = weighted.join(F.broadcast(model.weights), "term").groupBy("uid", "template", "license", "nv").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norm, "uid").select("uid", "license", F.round(F.col("dot") / (F.col("nw") * F.col("nv")), 6).alias("score")).filter(F.col("score") >= MIN_SCORE)
    best = cosine.groupBy("uid").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("uid", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per input row: path, license, score, origin (own or inherited), origin_dir."""
    ws = Workspace(files.sparkSession)
    files = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    paths = ws.table(files.select("path"), "paths")  # a path may follow from the text: no later step reads that for it
    model = Model(files, templates)
    units = ws.table(units_of(files, model.keys).withColumn("uid", F.sha2("unit", 256)), "units")
    scored = ws.table(score_units(units.filter("spdx is null"), model), "scored")
    said = units.select("path", "uid").join(scored, "uid").select("path", "license", "score")
    said = said.unionByName(units.filter("spdx is not null").select("path", F.col("spdx").alias("license"), F.lit(1.0).alias("score")))
    best = said.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    own = ws.table(best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "own")
    licensed = own.filter(basename(F.col("path")).rlike(LICENSE_FILE)).withColumn("dir", directory(F.col("path")))
    licensed = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b"))
    licensed = licensed.select(F.col("dir").alias("above"), F.col("b.license").alias("above_license"), (-F.col("b.s")).alias("above_score"))
    dirs = paths.filter(F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    near = dirs.select("dir", F.explode(F.array_distinct(up)).alias("above")).join(licensed, "above")
    near = near.groupBy("dir").agg(F.max_by(F.struct("above", "above_license", "above_score"), F.length("above")).alias("a"))
    near = ws.table(near, "near")  # so that the planner may split the join where a directory is hot
    rows = paths.withColumn("dir", directory(F.col("path"))).join(own, "path", "left").join(near, "dir", "left")
    mine = F.col("license").isNotNull()
    theirs = F.col("path").isNotNull() & F.col("a").isNotNull()
    return rows.select(
        "path",
        F.when(mine, F.col("license")).when(theirs, F.col("a.above_license")).alias("license"),
        F.when(mine, F.col("score")).when(theirs, F.col("a.above_score")).alias("score"),
        F.when(mine, F.lit("own")).when(theirs, F.lit("inherited")).alias("origin"),
        F.when(mine, F.col("dir")).when(theirs, F.col("a.above")).alias("origin_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/ID.txt, or source/lang/LICENSE-ID if lines with a licence word make up half of the text."""
    text = F.coalesce("text", F.lit(""))
    worded = lambda x: x.rlike(FILE_WORDS)
    size = F.aggregate(F.filter(F.split(text, "\n"), worded), F.lit(0), lambda n, x: n + F.length(x) + 1)
    mostly = worded(text) & (2 * (size - 1) >= F.length(text))
    name = F.when(mostly, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    return docs.select(F.concat(folder, F.lit("/"), name).alias("path"), "text")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    out = license_scan(document_files(load(spark, sf_dir, "documents")))
    return out.select(F.regexp_extract("path", r"([0-9]+)(\.txt)?$", 1).cast("long").alias("doc_id"), "path", "license", "score", "origin", "origin_dir")


_QUOTE = lambda text: "'" + text.replace("'", "''") + "'"
_TEMPLATE_ROWS = ", ".join(f"({i}, {_QUOTE(k)}, {_QUOTE(text)})" for i, (k, text) in enumerate(TEMPLATES))
_LOW = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
_WORDED = lambda x: f"regexp_matches({x}, '{FILE_WORDS}')"

QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {
    "op3_license_scan": rf"""
WITH c AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none')) AS dir,
         string_split(coalesce(text, ''), chr(10)) AS lines,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_WORDED('x')}) AS cued FROM documents),
f AS (
  SELECT *, CASE WHEN len(cued) > 0 AND 2 * length(array_to_string(cued, chr(10))) >= length(text)
                 THEN dir || '/LICENSE-' || doc_id ELSE dir || '/' || doc_id || '.txt' END AS path FROM c),
parts AS (
  SELECT path, unnest(list_concat(lines, list_transform(range(1, len(lines) + 1), lambda i: concat_ws(' ', lines[i], lines[i + 1])),
                                  regexp_split_to_array(text, '{BLANK}'))) AS unit FROM f),
u AS (
  SELECT DISTINCT path, unit FROM parts WHERE NOT regexp_matches(unit, '{NEGATED}')
  UNION SELECT path, text FROM f WHERE path LIKE '%/LICENSE-%'),
spdx AS (
  SELECT path, regexp_replace(regexp_extract(line, '{SPDX_ID}', 1), '{SPDX_LATER}', '') AS license, 1.0::DOUBLE AS score
  FROM (SELECT path, unnest(lines) AS line FROM f) WHERE regexp_extract(line, '{SPDX_ID}', 1) <> ''),
t AS (
  SELECT template, license, term, count(*) AS tf
  FROM (SELECT template, license, unnest(regexp_extract_all({_LOW('text')}, '{TERM}')) AS term
        FROM (VALUES {_TEMPLATE_ROWS}) AS v(template, license, text)) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM f),
df AS (
  SELECT term, count(*) AS df FROM (SELECT DISTINCT path, unnest(regexp_extract_all({_LOW('text')}, '{TERM}')) AS term FROM f)
  WHERE term IN (SELECT term FROM t) GROUP BY term),
idf AS (SELECT DISTINCT t.term, ln(1 + n / (1.0 + coalesce(df, 0))) AS idf FROM t LEFT JOIN df ON t.term = df.term, n),
units AS (SELECT unit, regexp_extract_all({_LOW('unit')}, '{TERM}') AS terms FROM (SELECT DISTINCT unit FROM u)),
tf AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(terms) AS term FROM units) GROUP BY ALL),
w AS (SELECT unit, tf.term, (1 + ln(tf)) * coalesce(idf, ln(1.0 + n)) AS w FROM tf LEFT JOIN idf ON tf.term = idf.term, n),
v AS (SELECT template, license, t.term, (1 + ln(tf)) * idf AS v FROM t JOIN idf ON t.term = idf.term),
nv AS (SELECT template, sqrt(sum(v * v)) AS nv FROM v GROUP BY template),
nw AS (SELECT unit, sqrt(sum(w * w)) AS nw FROM w GROUP BY unit),
cos AS (
  SELECT w.unit, v.license, round(sum(w * v) / (any_value(nw) * any_value(nv)), 6) AS score
  FROM w JOIN v ON w.term = v.term JOIN nw ON w.unit = nw.unit JOIN nv ON v.template = nv.template GROUP BY w.unit, v.template, v.license),
said AS (SELECT path, license, score FROM u JOIN cos ON u.unit = cos.unit WHERE score >= {MIN_SCORE} UNION ALL SELECT * FROM spdx),
own AS (SELECT path, license, score FROM said QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
lic AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS above, license, score FROM own WHERE path LIKE '%/LICENSE-%'
  QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, path) = 1),
near AS (
  SELECT dir, above, license, score FROM (SELECT DISTINCT dir FROM f) JOIN lic
    ON above = '' OR dir = above OR starts_with(dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.license, near.license) AS license, coalesce(own.score, near.score) AS score,
       CASE WHEN own.path IS NOT NULL THEN 'own' WHEN near.dir IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own.path IS NOT NULL THEN f.dir ELSE near.above END AS origin_dir
FROM f LEFT JOIN own ON f.path = own.path LEFT JOIN near ON f.dir = near.dir
""",
}
