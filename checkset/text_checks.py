"""Text rules over documents, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.registry import query
from checkset.tables import Tables
from trainlake.functions import text as tx

_BLANKS = tx.BLANKS
_CLEAN = (
    f"trim(translate(replace(replace({{c}}, '{tx.ESCAPED_ZERO_WIDTH}', ''), chr(8203), ''), "
    f"chr(10) || chr(13), '  '), '{_BLANKS}')"
)


@query(
    f"SELECT doc_id, {_CLEAN.format(c='text')} AS text, {_CLEAN.format(c='lang')} AS lang, "
    f"{_CLEAN.format(c='source')} AS source, n_chars FROM documents"
)
def clean_text(t: Tables) -> DataFrame:
    return tx.clean_text(t.documents)


@query(
    f"""SELECT doc_id,
      regexp_replace(trim(lower(text), '{_BLANKS}'), '{tx.BLANK_CLASS}+', ' ', 'g') AS text_norm
    FROM documents"""
)
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.normalize_text("text").alias("text_norm"))


@query("SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM orders")
def clean_categories(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\t"))
    orders = t.orders.select("o_orderkey", padded.alias("o_orderpriority"))
    return tx.clean_categories(orders, ["o_orderpriority", "absent"])


@query("SELECT o_orderkey, translate(lower(o_orderpriority), ' -', '__') AS slug FROM orders")
def slug(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tx.slug("o_orderpriority").alias("slug"))


@query(
    """SELECT c_custkey,
      CASE WHEN length(c_name) <= 8 THEN '***'
           ELSE left(c_name, 4) || '...' || right(c_name, 4) END AS name_mask,
      CASE WHEN c_mktsegment = 'BUILDING' THEN '(vazia)'
           WHEN length(c_mktsegment) <= 8 THEN '***'
           ELSE left(c_mktsegment, 4) || '...' || right(c_mktsegment, 4) END AS segment_mask
    FROM customer"""
)
def mask(t: Tables) -> DataFrame:
    secret = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.select(
        "c_custkey", tx.mask("c_name").alias("name_mask"), tx.mask(secret).alias("segment_mask")
    )


@query(
    """SELECT c_custkey, lower(c_name) || '@example.com' AS email FROM customer"""
)
def canonical_email(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.COM\n"))
    return t.customer.select("c_custkey", tx.canonical_email(raw).alias("email"))


@query(
    """SELECT o_orderkey, coalesce(nullif(substr(replace(trim(
        CASE WHEN o_orderstatus = 'P' THEN '-' ELSE o_orderpriority END), '-', ''), 1, 12), ''),
        'anon') AS token FROM orders"""
)
def user_token(t: Tables) -> DataFrame:
    key = F.when(F.col("o_orderstatus") == "P", F.lit("-")).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", tx.user_token(key).alias("token"))


@query("SELECT p_partkey, replace(p_name, ' ', '|') AS items FROM part")
def parse_list(t: Tables) -> DataFrame:
    listed = F.concat(F.lit("['"), F.replace(F.col("p_name"), F.lit(" "), F.lit("', ' ")), F.lit("', '']"))
    return t.part.select("p_partkey", F.array_join(tx.parse_list(listed), "|").alias("items"))
