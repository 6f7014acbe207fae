"""Layout of word boxes, labels and regions, on boxes made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from .registry import Tables, query

#: The box of the i-th word of a text, in both engines: eight words a row, rows that lean, gaps now and then.
_BOX = {
    "x0": "(i % 8) * 120 + (CASE WHEN (i + d) % 5 = 0 THEN 60 ELSE 0 END)",
    "y0": "(i // 8) * 40 + (i % 3) * 2 + (CASE WHEN (i + d) % 7 = 0 THEN 3 ELSE 0 END)",
    "x1": "(i % 8) * 120 + 90",
    "y1": "(i // 8) * 40 + 20 + (i % 4)",
}
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')"


def boxes(t: Tables):
    """The words of conversations as boxes on pages."""
    w = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), (F.col("turn") % 11).alias("d"), F.posexplode(F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")).alias("i", "text"))
    return w.select("page_id", "i", "text", *[F.expr(e.replace("//", "div")).cast("int").alias(n) for n, e in _BOX.items()])


@query(f"""
WITH t AS (SELECT conv_id * 1000 + turn AS page_id, turn % 11 AS d, {_WORDS} AS w FROM conversations),
u AS (SELECT page_id, d, unnest(w) AS text, unnest(range(len(w))) AS i FROM t),
b AS (SELECT page_id, i, text, {", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in _BOX.items())} FROM u),
c AS (SELECT *, (y0 + y1) / 2 AS c, y1 - y0 AS h FROM b),
n AS (SELECT *, coalesce(c - lag(c) OVER w > greatest(6, 0.45 * greatest(h, lag(h) OVER w)), true) AS fresh FROM c WINDOW w AS (PARTITION BY page_id ORDER BY c, x0, y0, x1, y1)),
l AS (SELECT *, CAST(count(*) FILTER (fresh) OVER (PARTITION BY page_id ORDER BY c, x0, y0, x1, y1 ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line FROM n),
a AS (SELECT *, coalesce(x0 - lag(x1) OVER w > 2.2 * greatest(h, lag(h) OVER w), true) AS apart FROM l WINDOW w AS (PARTITION BY page_id, line ORDER BY x0, c, y0, x1, y1)),
s AS (SELECT *, CAST(count(*) FILTER (apart) OVER w AS INTEGER) AS segment FROM a WINDOW w AS (PARTITION BY page_id, line ORDER BY x0, c, y0, x1, y1 ROWS UNBOUNDED PRECEDING))
SELECT page_id, line, segment, string_agg(text, ' ' ORDER BY x0, c, y0, x1, y1) AS words, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM s GROUP BY ALL""")
def laid_out_words(t: Tables):
    """Lines and segments of all pages."""
    return L.segments(L.lines(boxes(t))).withColumn("words", F.array_join("words", " "))


#: The label that a customer's row prints, well or badly, and what stands around it.
_PRINTED = "CASE k % 9 WHEN 0 THEN 'Passport No: K1234' WHEN 1 THEN 'SURNAME DOE' WHEN 2 THEN 'Date of Iss: e 1 May' WHEN 3 THEN 'Given Nmes JANE' WHEN 4 THEN 'Nat1onality: SURNAME' WHEN 5 THEN 'Categori B' WHEN 6 THEN 'xx DateofExpiry 2030 Place of Birth' WHEN 7 THEN 'Sexx M' ELSE 'nothing here' END"


@query(f"""
WITH c AS (SELECT c_custkey AS k, {_PRINTED.replace('k %', 'c_custkey %')} AS p FROM customer)
SELECT k AS row_id, h.s AS start, h.e AS "end", h.f AS field FROM (
  SELECT k, unnest(CASE k % 9
    WHEN 0 THEN [{{'s': 0, 'e': 2, 'f': 'document_number'}}] WHEN 1 THEN [{{'s': 0, 'e': 1, 'f': 'surname'}}]
    WHEN 2 THEN [{{'s': 0, 'e': 3, 'f': 'date_of_issue'}}] WHEN 3 THEN [{{'s': 0, 'e': 2, 'f': 'given_names'}}]
    WHEN 4 THEN [{{'s': 0, 'e': 1, 'f': 'nationality'}}] WHEN 5 THEN [{{'s': 0, 'e': 1, 'f': 'licence_categories'}}]
    WHEN 6 THEN [{{'s': 1, 'e': 2, 'f': 'date_of_expiry'}}, {{'s': 3, 'e': 6, 'f': 'place_of_birth'}}] ELSE [] END) AS h FROM c)""")
def printed_labels(t: Tables):
    """Labels as they are read, with their faults."""
    rows = t.spread(t.customer.select(F.col("c_custkey").alias("k"))).select(F.col("k").alias("row_id"), F.split(F.expr(_PRINTED), " ").alias("words"))
    return L.label_hits(rows, ["row_id"]).drop("score")


_REGION = {"x0": "CAST(l_partkey * 7 % 700 AS INTEGER)", "y0": "CAST(l_suppkey * 13 % 400 AS INTEGER)"}
_SIZE = {"x1": "x0 + CAST(10 + l_partkey % 5 * 60 AS INTEGER)", "y1": "y0 + CAST(10 + l_suppkey % 3 * 50 AS INTEGER)"}
_ZONES = [("portrait", 0, 100, 200, 350), ("mrz", 0, 420, 800, 500), ("surname", 210, 40, 500, 80), ("given_names", 210, 90, 500, 130), ("number", 480, 60, 800, 120)]


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"{e} AS {n}" for n, e in _REGION.items())}, l_discount * 2 AS ink FROM lineitem),
b AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _SIZE.items())} FROM r),
z(zone, a0, b0, a1, b1) AS (VALUES {", ".join(str(z) for z in _ZONES)}),
m AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, x0, y0, x1, y1, ink, zone, b0 * 0 AS shift, CAST(greatest(0, least(x1, a1 + l_orderkey % 3 * 10) - greatest(x0, a0 + l_orderkey % 3 * 10)) * greatest(0, least(y1, b1) - greatest(y0, b0)) AS DOUBLE) / ((x1 - x0) * (y1 - y0)) AS share FROM b, z),
s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, any_value(x1 - x0) AS w, any_value(y1 - y0) AS h, any_value(ink) AS ink, max(share) FILTER (zone = 'portrait') AS p, max(share) FILTER (zone = 'mrz') AS m,
         max({{'s': share, 'z': zone}}) FILTER (zone NOT IN ('portrait', 'mrz')) AS f
  FROM m GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN p > 0.3 THEN 'photo_replacement' WHEN m > 0.3 THEN 'mrz_alteration' WHEN f.s > 0.2 THEN 'text_manipulation' WHEN ink > 0.12 THEN 'stamp_forgery' WHEN w > 3 * h THEN 'text_manipulation' ELSE 'unattributed_alteration' END AS label,
       CASE WHEN p <= 0.3 AND m <= 0.3 AND f.s > 0.2 THEN f.z END AS target
FROM s""")
def region_labels(t: Tables):
    """Altered regions by the zones of their document."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # Boxes follow from the keys, so that they are not shuffled with them.
    r = t.lineitem.select(*keys, (F.col("l_discount") * 2).alias("ink_ratio")).dropDuplicates(keys)
    r = r.withColumns({n: F.expr(e) for n, e in _REGION.items()}).withColumns({n: F.expr(e) for n, e in _SIZE.items()}).withColumn("region_id", F.struct(*keys[1:]))
    z = F.explode(F.array(*[F.struct(F.lit(n).alias("zone"), *[F.lit(v).alias(c) for c, v in zip(("zx0", "zy0", "zx1", "zy1"), box, strict=True)]) for n, *box in _ZONES]))
    zones = t.lineitem.select("l_orderkey").distinct().select("l_orderkey", z.alias("z")).select("l_orderkey", "z.*")
    moved = (F.col("l_orderkey") % 3 * 10).cast("int")
    return L.attributed(r, zones.withColumns({"zx0": F.col("zx0") + moved, "zx1": F.col("zx1") + moved}), "l_orderkey").select(*keys, "label", "target")
