"""Metadata enrichment: field selection, typed cleaning, and the enriched view."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.functions import clean
from weirline.functions.stats import pct
from weirline.operators.purge import authentic_rows
from weirline.operators.spread import MOST_PIECES, frequent, may_share, on_grid, shared_keys, spread_join, with_matches, with_pieces
from weirline.schemas import (
    ENRICHMENT_COORDINATES, ENRICHMENT_FLAGS, ENRICHMENT_MEASURES, ENRICHMENT_TEXT,
    ENRICHMENT_TYPES, METADATA_SOURCE_FIELDS, VIEW_DAM_COLUMNS, VIEW_ENRICHMENT_COLUMNS,
)

log = logging.getLogger(__name__)

# Fixed value: the fallback join key is the first 10 characters of the comment.
COMMENT_KEY_LEN = 10
# Dams of a country that the view's join keeps at hand at once, roughly.
PIECE_ROWS = 4096


def select_fields(raw: DataFrame) -> tuple[DataFrame, dict, list]:
    """Select and rename the metadata fields that are present.

    Returns ``(frame, present map, missing source fields)``.  Missing fields are
    skipped, not an error; the list is for the report.
    """
    present = {s: t for s, t in METADATA_SOURCE_FIELDS.items() if s in raw.columns}
    missing = [s for s in METADATA_SOURCE_FIELDS if s not in raw.columns]
    if missing:
        log.warning("metadata fields missing: %s", missing)
    return raw.select(*[F.col(s).alias(t) for s, t in present.items()]), present, missing


_NUMERIC = set(ENRICHMENT_MEASURES) | set(ENRICHMENT_COORDINATES) | {"construction_year_gdw",
                                                                       "pre_construction_year"}


def clean_rules(df: DataFrame, coords_as_written: bool = False) -> dict[str, Column]:
    """Column -> cleaning rule, for the columns of ``df``.  Numeric columns are
    expected already parsed to double (see :func:`clean_enrichment`)."""
    rules: dict[str, Column] = {}
    for c in df.columns:
        if c in ENRICHMENT_MEASURES:
            rules[c] = clean.nonneg(c)
        elif c in ENRICHMENT_COORDINATES:
            rules[c] = clean.coordinate(c, as_written=coords_as_written)
        elif c == "construction_year_gdw":
            rules[c] = clean.year_rounded(c, clean.ENRICHMENT_YEAR_MIN, clean.ENRICHMENT_YEAR_MAX)
        elif c == "pre_construction_year":
            rules[c] = clean.year_rounded(c)
        elif c in ENRICHMENT_TEXT:
            rules[c] = clean.clean_text(c)
        elif c in ENRICHMENT_FLAGS:
            rules[c] = clean.usage_flag(c)
        elif c == "data_quality_gdw":
            rules[c] = clean.quality_text(c)
        else:
            rules[c] = F.col(c)
    return rules


def clean_enrichment(selected: DataFrame, coords_as_written: bool = False) -> DataFrame:
    """Apply the cleaning rules and store with the enrichment column types.

    First projection: numeric text -> double, parsed once.  Second: the rules
    and the stored types.  Decimal casts are ANSI casts: a value that does not
    fit its DECIMAL(p,s) fails the job, as it fails the insert in the original
    schema.
    """
    parsed = selected.select(*[clean.parse_number(c).alias(c) if c in _NUMERIC else F.col(c)
                               for c in selected.columns])
    rules = clean_rules(parsed, coords_as_written)
    return parsed.select(*[
        rules[c].cast(ENRICHMENT_TYPES[c]).alias(c) if c in ENRICHMENT_TYPES else rules[c].alias(c)
        for c in parsed.columns
    ])


def enrichment_table(raw_metadata: DataFrame, coords_as_written: bool = False) -> DataFrame:
    """Metadata attributes -> typed enrichment rows (selection + cleaning)."""
    selected, _, _ = select_fields(raw_metadata)
    return clean_enrichment(selected, coords_as_written)


def completeness_all(enrichment: DataFrame) -> DataFrame:
    """Completeness of every column: one pass of ``count(col)``, then unpivot."""
    cols = enrichment.columns
    wide = enrichment.agg(F.count(F.lit(1)).alias("_total"),
                          *[F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_nn_{i}").alias("non_null_count"))
        for i, c in enumerate(cols)
    ])).alias("s")
    return (wide.select(F.col("_total").alias("total_count"), stack)
            .select(F.col("s.column_name").alias("column_name"),
                    F.col("s.non_null_count").alias("non_null_count"),
                    F.col("total_count"))
            .withColumn("completeness_pct", pct("non_null_count", "total_count")))


@dataclass
class ViewParts:
    """The enriched view without its pairs by comment key written out.

    Every dam of a country matches every metadata row whose comment key is that country: as
    many rows as the product of the two, so they are kept as the two sides.  The view is
    ``rows`` plus, for each key, all pairs of ``dams`` and ``metadata``: none is left out
    and none is in both.
    """
    rows: DataFrame         # name matches whose key differs, and dams without any match
    dams: DataFrame         # dams whose country is some row's comment key
    metadata: DataFrame     # metadata whose comment key (``_ck``) is some dam's country

    @classmethod
    def of(cls, view: DataFrame | ViewParts) -> ViewParts:
        """A view given as its rows has no pairs kept as two sides."""
        none = view.limit(0) if isinstance(view, DataFrame) else None
        return view if none is None else cls(view, none, none.withColumn("_ck", F.col("country_code")))

    def pairs(self, hot: dict | None = None) -> DataFrame:
        return spread_join(self.dams, self.metadata, "country_code", "_ck", "inner", hot, None, ["dam_id"], ["gdw_id"]).select(*self.rows.columns)

    def view(self, hot: dict | None = None) -> DataFrame:
        """All rows of the view."""
        return self.rows.unionByName(self.pairs(hot))

    def totals(self, filled: Sequence[str] = (), true: Sequence[str] = (), summary: bool = False) -> DataFrame:
        """One row over all rows of the view: how many (``rows``), non-NULL values of each of
        ``filled``, true values of each of ``true``; with ``summary`` the years, countries and
        heights of the overview.  Pairs by key are counted from their two sides."""
        n, h, hg = F.count(F.lit(1)), F.col("height_meters"), F.col("height_meters_gdw")
        value = lambda c: F.count_if(F.col(c) == F.lit(True)) if c in true else F.count(c)
        counted = [*filled, *true]
        own = [c for c in counted if c in self.metadata.columns]
        dams = [c for c in counted if c not in own]
        decimal = "decimal(38,2)"
        both = F.coalesce(hg, h) if summary else None
        flat = [n.alias("rows"), *[value(c).alias(c) for c in counted]]
        per_d, per_e = [n.alias("_d"), *[value(c).alias(c) for c in dams]], [n.alias("_e"), *[value(c).alias(c) for c in own]]
        d, e = F.col("_d"), F.col("_e")
        paired = [F.sum(d * e).alias("rows"), *[F.sum(F.col(c) * (e if c in dams else d)).alias(c) for c in counted]]
        sums, ends = ["rows", *counted], []
        if summary:
            y, yg = "construction_year", "construction_year_gdw"
            flat += [F.sum(both).cast(decimal).alias("h_sum"), F.count(both).alias("h_cnt"), F.max(both).alias("h_max"),
                     F.min(F.least(y, yg)).alias("first_year"), F.max(F.greatest(y, yg)).alias("last_year")]
            per_d += [F.sum(h).alias("d_sum"), F.count(h).alias("d_cnt"), F.max(h).alias("d_max"), F.min(y).alias("d_first"), F.max(y).alias("d_last")]
            per_e += [F.sum(hg).alias("e_sum"), F.count(hg).alias("e_cnt"), F.max(hg).alias("e_max"), F.min(yg).alias("e_first"), F.max(yg).alias("e_last")]
            bare = e - F.col("e_cnt")       # metadata without a height: the dam's counts
            zero = lambda c: F.coalesce(F.col(c), F.lit(0))
            paired += [F.sum(zero("e_sum") * d + zero("d_sum") * bare).cast(decimal).alias("h_sum"), F.sum(F.col("e_cnt") * d + F.col("d_cnt") * bare).alias("h_cnt"),
                       F.max(F.greatest("e_max", F.when(bare > 0, F.col("d_max")))).alias("h_max"),
                       F.min(F.least("d_first", "e_first")).alias("first_year"), F.max(F.greatest("d_last", "e_last")).alias("last_year")]
            sums += ["h_sum", "h_cnt"]
            ends = [F.max("h_max").alias("h_max"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year")]
        by_key = self.dams.groupBy(F.col("country_code").alias("_k")).agg(*per_d).join(self.metadata.groupBy(F.col("_ck").alias("_k")).agg(*per_e), "_k").agg(*paired)
        out = self.rows.agg(*flat).unionByName(by_key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *ends)
        if summary:
            codes = self.rows.select("country_code").unionByName(self.dams.select("country_code"))
            out = out.crossJoin(codes.agg(F.count_distinct("country_code").alias("countries")))
        return out


VIEW_PARTS = [f.name for f in fields(ViewParts)]


def read_view(spark: SparkSession, path: str) -> ViewParts:
    """The parts of a view that ``sinks.refresh_parts`` has written."""
    return ViewParts(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in VIEW_PARTS])


def view_parts(dams: DataFrame, enrichment: DataFrame, authentic: Column | None = None) -> ViewParts:
    """Authentic dams LEFT JOIN enrichment ON name = name_gdw OR country = comment key, its
    pairs by key kept as two sides (see ``ViewParts``)."""
    d = authentic_rows(dams, authentic).select(*[F.col(s).alias(t) for s, t in VIEW_DAM_COLUMNS if s in dams.columns])
    own = [c for c in VIEW_ENRICHMENT_COLUMNS if c in enrichment.columns]
    e = enrichment.select(*own)
    out_cols = d.columns + own
    comment_key = F.substring("gdw_comments", 1, COMMENT_KEY_LEN)

    names, countries = frequent(d, "dam_name"), frequent(d, "country_code")    # each serves two joins
    by_name = spread_join(d, e, "dam_name", "dam_name_gdw", "inner", names, None, ["dam_id"], ["gdw_id"])
    same_key = F.coalesce(F.col("country_code") == comment_key, F.lit(False))
    # Few comments begin with a country: the others are out before anything is dealt.
    keyed = spread_join(e.withColumn("_ck", comment_key), d.select(F.col("country_code").alias("_ck")), "_ck", "_ck", "left_semi", left_spread=["gdw_id"])
    matched = spread_join(d, keyed, "country_code", "_ck", "left_semi", countries, left_spread=["dam_id"])
    lone = spread_join(d, e, "dam_name", "dam_name_gdw", "left_anti", names, left_spread=["dam_id"])
    lone = spread_join(lone, keyed, "country_code", "_ck", "left_anti", countries, left_spread=["dam_id"])
    types = {f.name: f.dataType for f in e.schema.fields}
    extended = lone.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in own])
    rows = by_name.where(~same_key).select(*out_cols).unionByName(extended.select(*out_cols))
    return ViewParts(rows, matched, keyed)


def enriched_view(dams: DataFrame, enrichment: DataFrame, authentic: Column | None = None,
                  shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Authentic dams LEFT JOIN enrichment ON name = name_gdw OR country = comment key.

    A disjunctive join condition has no equi-key, so Spark would plan it as a
    broadcast nested-loop join (every dam against every metadata row).  It is
    written as two equi-joins, with the same multiset of rows:

    * dams LEFT JOIN metadata by name, without the pairs that match by key too; a dam
      that no row matches by name is NULL-extended here, if none matches by key either;
    * metadata whose comment key is a country JOIN the dams of that country.

    The pairs by key are many times the rows of either side, so what a pair costs decides.
    Metadata, the wider side, comes first: Spark reads its columns once a row, not once
    a pair, and keeps the dams of a key at hand, dealt to pieces that are small.  ``shape``
    says how columns are shown; it is applied to the rows of each side, not to the pairs.
    It must keep ids, names, country and comments as they are, and NULL NULL.

    A name or a key that holds a large share of either table is dealt to several
    tasks (``spread.shared_keys``), and so are dams without a name or a country.
    All of it is one plan: no job runs before the rows are asked for.  Columns of
    the view that an input does not have are left out.
    """
    shape = shape or (lambda rows: rows)
    d = shape(authentic_rows(dams, authentic).select(*[F.col(s).alias(t) for s, t in VIEW_DAM_COLUMNS if s in dams.columns]))
    own = shape(enrichment.select(*[c for c in VIEW_ENRICHMENT_COLUMNS if c in enrichment.columns]))
    e = own.withColumn("_ck", F.substring("gdw_comments", 1, COMMENT_KEY_LEN))
    names, _ = shared_keys(d, "dam_name", e, "dam_name_gdw")
    countries = shared_keys(d, "country_code", e, "_ck", left_rows=PIECE_ROWS)
    out = [*[F.col(f"d.{c}") for c in d.columns], *[F.col(f"e.{c}") for c in own.columns]]
    on = lambda *keys: reduce(and_, [F.col(f"d.{c}") == F.col(f"e.{c}") for c in (*keys, "_i", "_j")])

    # By name.  Dams without a name, or with a frequent one that no metadata has, meet nothing: they are dealt evenly.
    meets = lambda name: F.when(F.coalesce("_n.both", F.lit(True)), F.col(name))
    pieces = lambda side: F.coalesce(F.when(F.col("_name").isNotNull(), F.coalesce(f"_n.{side}", F.lit(1))), F.lit(MOST_PIECES if side == "pl" else 1))
    left = with_matches(with_pieces(d, "dam_name", names, "_n"), "country_code", *countries, "_c", ["dam_id"]).withColumn("_name", meets("dam_name"))
    left = on_grid(left.withColumn("_alone", ~F.col("_c.both") & ~F.coalesce("_n.both", F.lit(False))), "_i", pieces("pl"), "dam_id", "_j", pieces("pr"))
    right = with_pieces(e, "dam_name_gdw", names, "_n").withColumn("_name", meets("dam_name_gdw")).where("_name IS NOT NULL")
    right = on_grid(right, "_j", pieces("pr"), "gdw_id", "_i", pieces("pl"))
    key_too = F.coalesce(F.col("d.country_code") == F.col("e._ck"), F.lit(False))
    by_name = left.alias("d").join(right.alias("e"), on("_name"), "left").where(F.when(F.col("e._name").isNull(), F.col("d._alone")).otherwise(~key_too)).select(*out)

    # By key.
    left = with_matches(d, "country_code", *countries, "_c", ["dam_id"]).where("_c.both").withColumn("_ck", F.col("country_code"))
    left = on_grid(left, "_i", F.col("_c.pl"), "dam_id", "_j", F.col("_c.pr"))
    right = with_matches(e.where(may_share("_ck", *countries)), "_ck", *countries, "_c", ["gdw_id"]).where("_c.both")
    right = on_grid(right, "_j", F.col("_c.pr"), "gdw_id", "_i", F.col("_c.pl"))
    return by_name.unionByName(right.alias("e").join(left.alias("d"), on("_ck")).select(*out))
