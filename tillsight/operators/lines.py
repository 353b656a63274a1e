"""Line aggregation, line differences, signed changes and price attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import text, values

MONEY = values.MONEY


def engine_lines(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Lines of each ``by`` per item key; price is the last line's, description and discount the first's."""
    w = Window.partitionBy(*by).orderBy(*order)
    keyed = lines.withColumn("_code", text.identity("item_code")).withColumn("_desc", text.identity("description")).withColumn("_at", F.row_number().over(w) - 1)
    keyed = keyed.withColumn("item_key", text.line_key(F.col("_code"), F.col("_desc"), F.col("_at"))).withColumn("_price", F.coalesce("modified_unit_price", "unit_price"))
    return keyed.groupBy(*by, "item_key").agg(
        F.min_by("description", "_at").alias("description"), F.sum(F.coalesce("quantity", F.lit(1))).cast(MONEY).alias("quantity"),
        F.max_by("_price", "_at").alias("unit_price"), F.min_by("discount", "_at").alias("discount"), F.sum("line_total").cast(MONEY).alias("total"),
    )


def view_lines(lines: DataFrame, by: list[str]) -> DataFrame:
    """The read models' flavour; price and discount are the first line's, and a null first total stays null."""
    keyed = lines.withColumn("item_key", text.view_line_key(F.col("item_code"), F.col("description"), F.col("sequence")))
    first = F.min_by(F.col("line_total").isNull(), "sequence")
    return keyed.groupBy(*by, "item_key").agg(
        F.min_by("description", "sequence").alias("description"), F.sum(F.coalesce("quantity", F.lit(1))).cast(MONEY).alias("quantity"),
        F.min_by(F.coalesce("modified_unit_price", "unit_price"), "sequence").alias("unit_price"), F.min_by("discount", "sequence").alias("discount"),
        F.when(~first, F.sum("line_total")).cast(MONEY).alias("line_total"),
    )


def _sides(before: DataFrame, after: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    left = before.select(*by, "item_key", F.lit(True).alias("had"), *[F.col(c).alias(f"before_{c}") for c in cols])
    right = after.select(*by, "item_key", F.lit(True).alias("has"), *[F.col(c).alias(f"after_{c}") for c in cols])
    return left.join(right, [*by, "item_key"], "full_outer")


def differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def line_changes(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """D1 over two ``engine_lines`` results: one change a key, the weightiest first."""
    both = _sides(before, after, by, ["description", "quantity", "unit_price", "discount", "total"])
    change = (
        F.when(F.col("had").isNull(), "ADDED").when(F.col("has").isNull(), "REMOVED").when(differs("before_quantity", "after_quantity"), "QUANTITY_CHANGED")
        .when(differs("before_unit_price", "after_unit_price"), "PRICE_CHANGED").when(differs("before_discount", "after_discount"), "DISCOUNT_CHANGED").otherwise("UNCHANGED")
    )
    description = F.when(F.col("has"), F.col("after_description")).otherwise(F.col("before_description"))
    return both.withColumn("change_type", change).withColumn("description", description).drop("had", "has", "before_description", "after_description")


def view_changes(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Five independent lists as flags: a key may be in several."""
    both = _sides(before, after, by, ["description", "quantity", "unit_price", "discount", "line_total"])
    stays = F.col("had").isNotNull() & F.col("has").isNotNull()
    return both.select(
        *by, "item_key", F.col("had").isNull().alias("added"), F.col("has").isNull().alias("removed"), (stays & differs("before_quantity", "after_quantity")).alias("quantity_changed"),
        (stays & differs("before_unit_price", "after_unit_price")).alias("price_changed"), (stays & differs("before_discount", "after_discount")).alias("discount_changed"),
    )


def apply_deltas(state: DataFrame, deltas: DataFrame, by: list[str]) -> DataFrame:
    """Lines after signed changes, in order, for each ``by`` and item key.

    ``state(by, item_key, description, quantity, unit_price, total)`` has one row a key, as ``engine_lines`` gives it;
    ``deltas`` has any number a key: ``(by, item_key, ordinal, description, quantity, unit_price, line_total, removed)``.
    A line whose quantity comes to zero or less goes, and so does one that a change removes. A change of no known line
    adds it as it was printed if its quantity is positive, and is passed over otherwise. Changed lines keep description and
    price, and their total follows the quantity where the price is known. ``position`` keeps the order: known
    lines first, added ones after them by their change. The fold runs inside an aggregate over a key's own changes.
    """
    line = f"struct<q:{MONEY},description:string,unit_price:{MONEY},total:{MONEY},added:int>"
    none = lambda c, t: F.col(c) if c in deltas.columns else F.lit(None).cast(t)
    delta = F.struct(
        F.col("ordinal").cast("int").alias("ordinal"), F.coalesce("quantity", F.lit(0)).cast(MONEY).alias("q"), F.coalesce("removed", F.lit(False)).alias("gone"),
        none("description", "string").alias("description"), none("unit_price", MONEY).cast(MONEY).alias("unit_price"), none("line_total", MONEY).cast(MONEY).alias("total"),
    )
    listed = deltas.groupBy(*by, "item_key").agg(F.array_sort(F.collect_list(delta)).alias("steps"))
    start = F.struct(F.coalesce("quantity", F.lit(1)).cast(MONEY).alias("q"), "description", F.col("unit_price").cast(MONEY).alias("unit_price"), F.col("total").cast(MONEY).alias("total"), F.lit(-1).alias("added"))
    known = state.withColumn("total", F.col("total") if "total" in state.columns else F.lit(None)).withColumn("description", F.col("description") if "description" in state.columns else F.lit(None).cast("string"))
    both = known.select(*by, "item_key", start.cast(line).alias("start")).join(listed, [*by, "item_key"], "full_outer")

    def step(acc, d):
        residual = (acc["q"] + d["q"]).cast(MONEY)
        moved = F.struct(residual.alias("q"), acc["description"].alias("description"), acc["unit_price"].alias("unit_price"), F.coalesce((acc["unit_price"] * residual).cast(MONEY), acc["total"]).alias("total"), acc["added"].alias("added"))
        fresh = F.struct(d["q"].alias("q"), d["description"].alias("description"), d["unit_price"].alias("unit_price"), d["total"].alias("total"), d["ordinal"].alias("added"))
        stays = ~d["gone"] & F.when(acc.isNotNull(), residual > 0).otherwise(d["q"] > 0)
        return F.when(stays, F.when(acc.isNotNull(), moved.cast(line)).otherwise(fresh.cast(line)))

    kind = f"array<struct<ordinal:int,q:{MONEY},gone:boolean,description:string,unit_price:{MONEY},total:{MONEY}>>"
    end = F.aggregate(F.coalesce("steps", F.array().cast(kind)), F.col("start"), step)
    left = both.withColumn("end", end).where(F.col("end").isNotNull())
    return left.select(*by, "item_key", F.col("end.description").alias("description"), F.col("end.q").alias("quantity"), F.col("end.unit_price").alias("unit_price"), F.col("end.total").alias("line_total"), F.col("end.added").alias("position"))


def attribute_prices(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Prices for lines without one, from priced lines of each related document.

    ``targets(transaction_id, line_id, item_code, description, quantity, observed_at)``; ``sources`` has also
    document_id, sequence, unit_price and line_total. Item code beats description; quantities must not
    conflict; one candidate is RESOLVED, several that agree AGREED, others AMBIGUOUS.
    """
    t = targets.select("transaction_id", F.col("line_id").alias("target"), text.price_code(F.col("item_code")).alias("code"), text.price_description(F.col("description")).alias("descr"), F.col("quantity").alias("tq"))
    price = values.unit_price(F.col("unit_price"), F.col("line_total"), F.col("quantity"))
    s = sources.where(F.col("unit_price").isNotNull() | F.col("line_total").isNotNull()).select(
        "transaction_id", F.col("line_id").alias("source"), F.col("document_id").alias("source_document"), "sequence", text.price_code(F.col("item_code")).alias("s_code"), text.price_description(F.col("description")).alias("s_descr"),
        F.col("quantity").alias("sq"), price["price"].alias("unit"), price["origin"].alias("origin"), values.half_up(F.col("line_total")).alias("total"),
    )
    fits = F.col("tq").isNull() | F.col("sq").isNull() | (F.abs("tq") == F.abs("sq"))
    by_code = t.where(F.col("code").isNotNull()).join(s, (t.transaction_id == s.transaction_id) & (F.col("code") == F.col("s_code")) & fits).drop(s.transaction_id).withColumn("basis", F.lit("ITEM_CODE_EXACT"))
    by_text = t.where(F.col("descr").isNotNull()).join(s, (t.transaction_id == s.transaction_id) & (F.col("descr") == F.col("s_descr")) & fits).drop(s.transaction_id).withColumn("basis", F.lit("DESCRIPTION_NORMALIZED_EXACT"))
    w = Window.partitionBy("transaction_id", "target", "source_document")
    found = by_code.unionByName(by_text).withColumn("_best", F.min(F.when(F.col("basis") == "ITEM_CODE_EXACT", 0).otherwise(1)).over(w)).where((F.col("_best") == 0) == (F.col("basis") == "ITEM_CODE_EXACT"))
    found = found.withColumns({
        "n": F.count("*").over(w), "units": F.size(F.collect_set("unit").over(w)), "totals": F.size(F.collect_set("total").over(w)),
        "all_units": F.min(F.col("unit").isNotNull()).over(w), "all_totals": F.min(F.col("total").isNotNull()).over(w),
    })
    agree = F.when(F.col("all_units"), (F.col("units") == 1) & (F.col("totals") <= 1)).when(F.col("all_totals"), (F.col("totals") == 1) & (F.col("units") <= 1)).otherwise(False)
    status = F.when(F.col("n") == 1, "RESOLVED").when(agree, "AGREED").otherwise("AMBIGUOUS")
    base = F.when(F.col("basis") == "ITEM_CODE_EXACT", F.lit(98)).otherwise(90) - F.when(F.col("tq").isNull() | F.col("sq").isNull(), 10).otherwise(0)
    base = base - F.when(F.col("origin") == "DERIVED_FROM_OBSERVED_LINE_TOTAL", 3).when(F.col("origin") == "UNAVAILABLE", 15).otherwise(0)
    points = F.when(status == "AGREED", F.least(F.lit(99), base + 1)).when(status == "AMBIGUOUS", F.least(F.lit(49), base)).otherwise(base)
    return found.select("transaction_id", "target", "source", "source_document", "basis", F.col("unit").alias("unit_price"), F.col("total").alias("line_total"), status.alias("status"), points.alias("confidence_points"))
