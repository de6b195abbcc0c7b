"""District lookups, the administrative catalog and its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight import domain
from wardlight.functions import geo
from wardlight.functions.text import label, normalize_admin_name, strip_district_suffix
from wardlight.operators import joins
from wardlight.operators.nearest import NearestIndex, attach_nearest
from wardlight.workspace import Workspace


def lookup_district(rows: DataFrame, districts: DataFrame) -> DataFrame:
    """Left lookup of ``districtId``; unknown districts show their id, 'Unknown' and (0, 0)."""
    dim = districts.select(
        F.col("id").alias("districtId"), F.col("name").alias("_name"), F.col("country").alias("_country"),
        F.col("lat").alias("_lat"), F.col("lng").alias("_lng"),
    )
    return joins.lookup(rows, dim, "districtId", "left").withColumns(
        {
            "districtName": F.coalesce("_name", "districtId"),
            "country": F.coalesce("_country", F.lit("Unknown")),
            "lat": F.coalesce("_lat", F.lit(0.0)),
            "lng": F.coalesce("_lng", F.lit(0.0)),
        }
    ).drop("_name", "_country", "_lat", "_lng")


def state_key(name: Column) -> Column:
    return F.lower(name)


def pair_key(state: Column, district: Column) -> Column:
    return F.concat(F.lower(state), F.lit("__"), F.lower(district))


def flatten_admin_catalog(catalog: DataFrame) -> DataFrame:
    """One row per catalog district with its state and the lookup keys of both."""
    return catalog.select(
        F.col("id").alias("stateId"), F.col("name").alias("stateName"), "kind",
        F.nullif(F.col("lgdCode"), F.lit("undefined")).alias("stateLgdCode"), F.explode("districts").alias("d"),
    ).select(
        F.col("d.id").alias("districtId"), F.col("d.name").alias("districtName"), F.col("d.lgdCode").alias("lgdCode"),
        "stateId", "stateName", "kind", "stateLgdCode",
        state_key(F.col("stateName")).alias("stateKey"),
        pair_key(F.col("stateName"), F.col("d.name")).alias("pairKey"),
    )


def canonicalize_districts(districts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rewrite districts to their catalog entry and keep one row per canonical id.

    ``districts`` has ``docId`` and ``ord`` besides the district columns; ``catalog`` is
    a flattened catalog.  The row whose ``docId`` is the canonical id wins, else the
    first.  Rows without a catalog entry stay as they are.
    """
    entry = F.struct("districtId", "districtName", "stateName")
    by_id = catalog.select(F.col("districtId").alias("id"), entry.alias("_by_id"))
    by_pair = catalog.groupBy(pair_key(F.col("stateName"), F.col("districtName")).alias("pairKey")).agg(F.max_by(entry, "districtId").alias("_by_pair"))
    keyed = districts.withColumn("pairKey", pair_key(F.col("state"), F.col("name")))
    matched = joins.lookup(joins.lookup(keyed, by_id, "id", "left"), by_pair, "pairKey", "left")
    found = F.coalesce("_by_id", "_by_pair")
    renamed = matched.select(
        "docId", "ord",
        F.coalesce(found["districtId"], "id").alias("id"), F.coalesce(found["districtName"], "name").alias("name"),
        "country", F.coalesce(found["stateName"], "state").alias("state"), "lat", "lng", "infraScore", "population",
    )
    preferred = F.struct((F.col("docId") != F.col("id")).alias("other"), "ord")
    return renamed.groupBy("id").agg(F.min_by(F.struct(*[c for c in renamed.columns if c != "id"]), preferred).alias("r")).select(
        "id", "r.*"
    )


def resolve_admin_unit(addresses: DataFrame, catalog: DataFrame) -> DataFrame:
    """District of a reverse-geocoded address (``pointId, lat, lng, country_code, state`` and seven fields).

    The first address field, in order, that names a district of the state wins.  All
    points are returned, with nulls where nothing matches.
    """
    raw_state = normalize_admin_name(F.col("state"))
    fields = F.array(*[F.col(f) for f in domain.ADDRESS_FIELDS])
    tried = addresses.filter("country_code = 'in' AND state IS NOT NULL").select(
        "pointId",
        F.coalesce(label(raw_state, domain.STATE_ALIASES), raw_state).alias("stateKey"),
        F.posexplode(fields).alias("pos", "field"),
    ).filter("field IS NOT NULL").withColumn(
        "districtKey", strip_district_suffix(normalize_admin_name(F.col("field")))
    )
    keys = catalog.select(
        normalize_admin_name(F.col("stateName")).alias("stateKey"),
        strip_district_suffix(normalize_admin_name(F.col("districtName"))).alias("districtKey"),
        F.struct("districtId", "districtName", "stateName").alias("unit"),
    ).groupBy("stateKey", "districtKey").agg(F.min("unit").alias("unit"))
    first = joins.lookup(tried, keys, ["stateKey", "districtKey"]).groupBy("pointId").agg(
        F.min_by("unit", "pos").alias("unit")
    )
    known = F.col("unit").isNotNull()
    return addresses.select("pointId", "lat", "lng").join(first, "pointId", "left").select(
        "pointId", F.col("unit.districtId").alias("id"), F.col("unit.districtName").alias("name"),
        F.when(known, "India").alias("country"), F.col("unit.stateName").alias("state"),
        F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lng")).alias("lng"),
        F.when(known, 5.0).alias("infraScore"), F.lit(None).cast("long").alias("population"),
    )


def ensure_district_rows(reports: DataFrame, districts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Districts plus a row, at the first report's place, for every reported catalog district without one."""
    missing = (
        reports.filter("districtId IS NOT NULL")
        .groupBy("districtId")
        .agg(F.min_by(F.struct("lat", "lng"), F.struct("timestamp", "id")).alias("at"))
        .join(districts.select(F.col("id").alias("districtId")), "districtId", "left_anti")
    )
    known = catalog.select("districtId", "districtName", "stateName")
    new = joins.lookup(missing, known, "districtId").select(
        F.col("districtId").alias("id"), F.col("districtName").alias("name"), F.lit("India").alias("country"),
        F.col("stateName").alias("state"), F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"),
        F.lit(5.0).alias("infraScore"), F.lit(None).cast("long").alias("population"),
    )
    return districts.select(*new.columns).unionByName(new)


def assign_district(
    reports: DataFrame, districts: DataFrame, workspace: Workspace | None = None, index: NearestIndex | None = None
) -> DataFrame:
    """Set ``districtId`` and ``stateName``: a known explicit id wins, else the nearest district.

    ``index`` is a prepared index over the same districts.
    Rows with neither a known id nor finite coordinates get null for both.
    """
    dim = districts.select(F.col("id").alias("districtId"), F.col("state").alias("_state"))
    matched = joins.lookup(reports, dim.withColumn("_known", F.lit(True)), "districtId", "left")
    explicit = matched.filter("_known").withColumn("stateName", F.col("_state")).drop("_known", "_state")
    rest = matched.filter("_known IS NULL").drop("_known", "_state")
    located = rest.filter(geo.located("lat", "lng"))
    placed = (index.attach(located) if index else attach_nearest(located, districts, workspace)).withColumns(
        {"districtId": F.col("best.id"), "stateName": F.col("best.state")}
    )
    nowhere = rest.filter(~geo.located("lat", "lng")).withColumns(
        {"districtId": F.lit(None).cast("string"), "stateName": F.lit(None).cast("string")}
    )
    columns = [*reports.columns, *([] if "stateName" in reports.columns else ["stateName"])]
    return explicit.select(*columns).unionByName(placed.select(*columns)).unionByName(nowhere.select(*columns))


def orphans(rows: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows whose non-null ``key`` is not in ``dim``."""
    known = dim.select(F.col(dim_key).alias(key)).distinct()
    return joins.lookup(
        rows.filter(F.col(key).isNotNull()), known.withColumn("_known", F.lit(True)), key, "left"
    ).filter("_known IS NULL").drop("_known")


def signup_districts(districts: DataFrame, seed: DataFrame) -> DataFrame:
    """Indian districts with a state; the whole seed table if there are none."""
    fit = districts.filter("country = 'India' AND state IS NOT NULL")
    columns = [f.name for f in domain.DISTRICT]
    return fit.select(*columns) if joins.has_rows(fit) else seed.select(*columns)


def search_admin_units(
    catalog: DataFrame, state_needle: str = "", district_needle: str = "",
    selected_state: str | None = None, selected_district: str | None = None,
) -> DataFrame:
    """Catalog rows whose names contain the needles, in any case; selected units stay listed."""
    in_state = F.lower("stateName").contains(state_needle.lower())
    in_district = F.lower("districtName").contains(district_needle.lower())
    if selected_state is not None:
        in_state = in_state | (F.col("stateName") == selected_state)
    if selected_district is not None:
        in_district = in_district | (F.col("districtId") == selected_district)
    return catalog.filter(in_state & in_district)


def catalog_quality(catalog: DataFrame, seed: DataFrame) -> DataFrame:
    """Long-form checks (``check, key, n``): units by kind, districts per state, bad and missing ids."""
    states = catalog.select("stateId", "kind").distinct()
    kinds = states.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("check"), F.col("kind").alias("key"), "n")
    per_state = catalog.groupBy("stateName").agg(F.count("*").alias("n")).select(
        F.lit("districts").alias("check"), F.col("stateName").alias("key"), "n"
    )
    ids = catalog.groupBy("districtId").agg(F.count("*").alias("n"))
    duplicate = ids.filter("n > 1").select(F.lit("duplicate").alias("check"), F.col("districtId").alias("key"), "n")
    invalid = ids.filter(~F.col("districtId").rlike(domain.DISTRICT_ID_PATTERN)).select(
        F.lit("invalid").alias("check"), F.col("districtId").alias("key"), "n"
    )
    missing = seed.select(F.col("id").alias("districtId")).join(ids, "districtId", "left_anti").select(
        F.lit("missing").alias("check"), F.col("districtId").alias("key"), F.lit(1).cast("long").alias("n")
    )
    return kinds.unionByName(per_state).unionByName(duplicate).unionByName(invalid).unionByName(missing)


def seed_quality(districts: DataFrame, complaints: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """One row of booleans about a seed data set."""
    wanted = languages or ["en", "hi", "bn", "ta"]
    d = districts.agg(
        F.count("*").alias("nd"), F.countDistinct("state").alias("ns"),
        F.count_if(~F.col("country").eqNullSafe("India")).alias("foreign"),
    )
    known = districts.select(F.col("id").alias("districtId"), F.lit(True).alias("_known")).distinct()
    c = joins.lookup(complaints, known, "districtId", "left").agg(
        F.count("*").alias("nc"), F.count_if(F.col("_known").isNull()).alias("no"),
        F.countDistinct(F.when(F.col("detectedLanguage").isin(wanted), F.col("detectedLanguage"))).alias("nl"),
    )
    one = d.withColumn("_k", F.lit(1)).join(c.withColumn("_k", F.lit(1)), "_k")
    return one.select(
        F.col("nd").between(25, 28).alias("districtCountOk"), (F.col("ns") >= 10).alias("statesOk"),
        (F.col("foreign") == 0).alias("onlyIndia"), (F.col("nc") == F.col("nd") * 4).alias("complaintCountOk"),
        (F.col("nl") == len(wanted)).alias("languagesOk"), (F.col("no") == 0).alias("noOrphans"),
    )
