"""Queries of the data-preparation problems of the core: nested records, stamps, as-known attributes, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import asknown, history, matching, nested, stamps
from tidewheel.session import cut, read

OFFERS = nested.Shape(
    levels=(
        nested.Level("offer", None, "offers", attributes=("id", "market_id", "event_id", "player_id", "team_id", "active")),
        nested.Level("participant", "offer", "participants", attributes=("id", "name")),
        nested.Level("player", "participant", "player", listed=False, attributes=("short_name", "first_name", "last_name", "position", "team", "slug", "jersey_number")),
        nested.Level("team", "participant", "team", listed=False, attributes=("city", "abbreviation", "conference", "division")),
        nested.Level("selection", "offer", "selections", attributes=("selection", "participant", "label", "active")),
        nested.Level("opening_line", "selection", "opening_line", listed=False, attributes=("line", "cost", "book_id", "created")),
        nested.Level("book", "selection", "books", attributes=("id",)),
        nested.Level("line", "book", "lines", attributes=("id", "main", "best", "cost", "line")),
    ),
    wrappers=("data",),
)
OFFER_TYPES = {"market_id": "int", "event_id": "int", "active": "boolean", "jersey_number": "int", "line": "double", "cost": "int", "book_id": "int", "main": "boolean", "best": "boolean"}
CASES = ("offer", "participant", "selection", "opening_line", "book", "line")


def _bare(shape: nested.Shape, nodes: tuple[str, ...], attributes: dict[str, tuple[str, ...]] | None = None) -> nested.Shape:
    return nested.Shape(tuple(nested.Level(x.node, x.parent, x.key, x.listed, (attributes or {}).get(x.node, ())) for x in shape.levels if x.node in nodes), shape.wrappers)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.linked_rows(read(spark, sf_dir, "offers_raw"), "record_id", "payload", _bare(OFFERS, CASES), "received_at")
    return rows.select("record_id", "node", "node_path")


def _flat(level: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shape = nested.branch(OFFERS, level)
        rows = nested.linked_rows(read(spark, sf_dir, "offers_raw"), "record_id", "payload", shape, "received_at")
        return nested.flat_tables(rows, "record_id", shape, OFFER_TYPES)[level]

    query.__name__ = f"p1_{level}s"
    return query


# What the feeds declare about their stamps.
FEEDS = {
    "statsapi": stamps.Convention("mdy", "utc", strict=False),
    "intl": stamps.Convention("dmy", "utc", strict=False),
    "primary": stamps.Convention("mdy", "utc", strict=False),
    "desk": stamps.Convention("mdy", "ny", strict=False),
    "mirror": stamps.Convention("mdy", "ny", strict=False),
    "park": stamps.Convention("mdy", "venue", strict=False),
}


def _by_source(fields: tuple[str, ...], conventions: dict[str, stamps.Convention]) -> dict[str, stamps.Convention]:
    return {f"{f}/{feed}": c for f in fields for feed, c in conventions.items()}


def official_days(spark: SparkSession, sf_dir: str, conventions: dict[str, stamps.Convention] = FEEDS) -> DataFrame:
    """Games with `day`, the date that their officialdate denotes, or NULL; written down once, as two results are made of it.

    The dates of a feed go through the same search as instants do; a date that only reads against its feed's rule is none.
    """
    games = read(spark, sf_dir, "schedule_games").select("schedule_id", "gamedate", "officialdate", "feed", "venue_id", "updated_at").distinct()
    values = stamps.with_date_readings(games, "officialdate", "days").withColumn("source", F.concat_ws("/", F.lit("officialdate"), "feed"))
    micros = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86400000000
    readings = F.transform("days", lambda x: F.struct(x["ord"].alias("ord"), F.lit("own").alias("zone"), micros(x["day"]).alias("at")))
    rules = _by_source(("officialdate",), conventions)
    chosen = stamps.choose_readings(values.withColumn("days", readings), "source", ["updated_at", "schedule_id", "officialdate"], "days", rules, unread=True)
    day = F.when(stamps.as_declared(F.col("source"), rules), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("read_at") / 86400000000).cast("int")))
    return cut(chosen.select(*games.columns, day.alias("day")))


def stamp_values(spark: SparkSession, sf_dir: str, games: DataFrame) -> DataFrame:
    """All stamps of the three tables, with their readings: (field, row_id, node_path, feed, seen, readings)."""
    zones = read(spark, sf_dir, "venues").groupBy("venue_id").agg(F.max("tz_name").alias("tz_name"))
    rows = lambda df, field, row_id, path, seen, text: df.select(F.lit(field).alias("field"), F.col(row_id).alias("row_id"), path.alias("node_path"), "feed", F.col(seen).alias("seen"), F.col(text).alias("text"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("tz_name", "string"), ("day", "date"))])
    game = rows(games.join(zones, "venue_id", "left"), "gamedate", "schedule_id", F.lit(""), "updated_at", "gamedate")
    event = rows(read(spark, sf_dir, "vendor_events").select("event_row_id", "scheduled", "feed", "received_at").distinct(), "scheduled", "event_row_id", F.lit(""), "received_at", "scheduled")
    shape = _bare(OFFERS, ("offer", "selection", "opening_line"), {"opening_line": ("created",)})
    raw = read(spark, sf_dir, "offers_raw")
    created = nested.linked_rows(raw, "record_id", "payload", shape, "received_at").filter("node = 'opening_line'").select("record_id", "node_path", F.col("attributes")["created"].alias("created"))
    feeds = raw.filter(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.max(F.struct("received_at", "feed"))["feed"].alias("feed"), F.max("received_at").alias("seen"))
    line = rows(created.filter("created is not null").join(feeds, "record_id"), "created", "record_id", F.col("node_path"), "seen", "created")
    # The slim rows are spread by key: the readings are the work here, and their steps would be planned once for each table below the union.
    texts = game.unionByName(event).unionByName(line).repartition("row_id", "node_path")
    values = stamps.with_instant_readings(texts, "text", "readings", "tz_name", "day")
    return values.select("field", "row_id", "node_path", "feed", "seen", "readings")


INSTANTS = ("gamedate", "scheduled", "created")


def _instants(spark: SparkSession, sf_dir: str, conventions: dict[str, stamps.Convention], games: DataFrame) -> DataFrame:
    values = stamp_values(spark, sf_dir, games).withColumn("source", F.concat_ws("/", "field", "feed"))
    return stamps.choose_readings(values, "source", ["seen", "row_id", "node_path"], "readings", _by_source(INSTANTS, conventions))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of every stamp compete in the search; what it could only read against its feed's rules is then checked out."""
    games = official_days(spark, sf_dir)
    chosen = _instants(spark, sf_dir, FEEDS, games).filter(stamps.as_declared(F.col("source"), _by_source(INSTANTS, FEEDS)))
    instants = chosen.select("field", "row_id", "node_path", stamps.utc_text(F.col("read_at")).alias("norm"))
    days = games.select(F.lit("officialdate").alias("field"), F.col("schedule_id").alias("row_id"), F.lit("").alias("node_path"), F.date_format("day", "yyyy-MM-dd").alias("norm"))
    return instants.unionByName(days.filter("norm is not null")).distinct()


#: The feeds without their order of day and month: only the path through each source's records can tell it.
LOOSE = {name: stamps.Convention(None, c.zone, strict=False) for name, c in FEEDS.items()}


def p2_inferred_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search finds out about each source when no order of day and month is declared: how many values it reads each way."""
    chosen = _instants(spark, sf_dir, LOOSE, official_days(spark, sf_dir, LOOSE))
    return chosen.groupBy("source", "read_order", "read_zone").agg(F.count(F.lit(1)).alias("n_values"))


def _endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per at-bat-ending pitch and side: (pitch_id, side, player_id, game_date)."""
    pitches = read(spark, sf_dir, "pitch_pool").filter("events is not null and pitch_id is not null").groupBy("pitch_id").agg(F.max(F.struct("game_date", "batter_id", "pitcher_id")).alias("p"))
    sides = F.explode(F.array(F.struct(F.lit("batter").alias("side"), F.col("p.batter_id").alias("player_id")), F.struct(F.lit("pitcher").alias("side"), F.col("p.pitcher_id").alias("player_id")))).alias("s")
    return pitches.select("pitch_id", F.col("p.game_date").alias("game_date"), sides).select("pitch_id", "game_date", "s.side", "s.player_id")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable metric rows of both sides: (side, player_id, asof_date, updated_at, metric_id)."""
    cols = lambda side, player: [F.lit(side).alias("side"), F.col(player).alias("player_id"), "asof_date", "updated_at", "metric_id"]
    batters = read(spark, sf_dir, "batter_season_metrics").filter("k_rate is not null").select(*cols("batter", "batter_id"))
    return batters.unionByName(read(spark, sf_dir, "pitcher_season_metrics").filter("sample_pitches is not null").select(*cols("pitcher", "pitcher_id")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = asknown.as_known_join(_endings(spark, sf_dir), _metrics(spark, sf_dir), ["side", "player_id"], "game_date", "asof_date", "updated_at", "metric_id")
    return joined.filter("metric_id is not null").select("pitch_id", "side", "metric_id")


P3_SQL = """
WITH ends AS (SELECT DISTINCT pitch_id, game_date, batter_id, pitcher_id FROM pitch_pool WHERE events IS NOT NULL AND pitch_id IS NOT NULL),
sides AS (SELECT pitch_id, game_date, 'batter' AS side, batter_id AS player FROM ends UNION ALL SELECT pitch_id, game_date, 'pitcher', pitcher_id FROM ends),
facts AS (SELECT DISTINCT 'batter' AS side, batter_id AS player, asof_date, updated_at, metric_id FROM batter_season_metrics WHERE k_rate IS NOT NULL AND asof_date IS NOT NULL
  UNION ALL SELECT DISTINCT 'pitcher', pitcher_id, asof_date, updated_at, metric_id FROM pitcher_season_metrics WHERE sample_pitches IS NOT NULL AND asof_date IS NOT NULL),
days AS (SELECT DISTINCT side, player, game_date FROM sides),
known AS (SELECT d.side, d.player, d.game_date, arg_max(f.metric_id, ROW(f.asof_date, f.updated_at, f.metric_id)) AS metric_id
  FROM days d JOIN facts f ON d.side = f.side AND d.player = f.player AND f.asof_date < d.game_date AND f.updated_at < CAST(d.game_date AS TIMESTAMP) GROUP BY 1, 2, 3)
SELECT s.pitch_id, s.side, k.metric_id FROM sides s JOIN known k USING (side, player, game_date)
"""


def p3_as_known_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome by outcome, how many at-bats had known metrics on each side and the mean k_rate that was known for their batters."""
    found = p3_found(spark, sf_dir)
    rates = read(spark, sf_dir, "batter_season_metrics").filter("k_rate is not null").select("metric_id", "k_rate").distinct().withColumn("side", F.lit("batter"))
    return found.join(rates, ["side", "metric_id"], "left").groupBy("side").agg(F.count(F.lit(1)).alias("n_known"), F.round(F.avg("k_rate"), 6).alias("mean_k_rate"))


def matched_events(t) -> DataFrame:
    """Vendor events with the scheduled game of the same two teams that starts nearest: both sides' stamps as the stamp operator reads them."""
    from tidewheel.plans.profiles import entity_match

    games, events = t("schedule_games"), t("vendor_events")
    days = games.select("schedule_id", "gamedate", "officialdate", "feed", "venue_id", "updated_at").withColumn("day", F.lit(None).cast("date"))
    zones = t("venues").groupBy("venue_id").agg(F.max("tz_name").alias("tz_name"))
    own = lambda df, i, text, seen: df.select(F.lit(text).alias("field"), F.col(i).alias("row_id"), "feed", F.col(seen).alias("seen"), F.col(text).alias("text"), "tz_name", "day")
    texts = own(days.join(zones, "venue_id", "left"), "schedule_id", "gamedate", "updated_at").unionByName(own(events.withColumns({"tz_name": F.lit(None).cast("string"), "day": F.lit(None).cast("date")}), "event_row_id", "scheduled", "received_at"))
    values = stamps.with_instant_readings(texts.distinct().repartition("row_id"), "text", "readings", "tz_name", "day").withColumn("source", F.concat_ws("/", "field", "feed"))
    rules = _by_source(INSTANTS, FEEDS)
    read_ = stamps.choose_readings(values.select("field", "row_id", "source", "seen", "readings"), "source", ["seen", "row_id"], "readings", rules).filter(stamps.as_declared(F.col("source"), rules))
    at = read_.groupBy("field", "row_id").agg(F.timestamp_micros(F.max_by("read_at", "seen")).alias("at"))
    when = lambda field, i: at.filter(F.col("field") == field).select(F.col("row_id").alias(i), "at")
    e = entity_match(t).join(when("scheduled", "event_row_id"), "event_row_id")
    g = games.select("schedule_id", "home_team_id", "away_team_id").distinct().join(when("gamedate", "schedule_id"), "schedule_id")
    return matching.nearest_in_time(e, g, ["home_team_id", "away_team_id"], "event_row_id", "schedule_id", "at", "at")


ENTITIES = {
    "manager": ("managers", "manager_id", {"assignment": ("team_id", "season_start", "season_end"), "identity": ("full_name",)}, {"assignment": ("team_id",), "identity": ("full_name",)}),
    "team": ("teams", "team_id", {"venue": ("venue_id",), "identity": ("team_name", "team_abbrev", "league", "division")}, {"venue": ("venue_id",), "identity": ("team_name",)}),
}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions from satellites that are split by measured change rates, with ends from a lead-based view."""
    out = None
    for entity, group in (("manager", "assignment"), ("team", "venue")):
        table, key, groups, required = ENTITIES[entity]
        v = history.split_history(read(spark, sf_dir, table), key, "snapshot_date", "updated_at", groups[group], required[group])
        v = v.select(F.lit(entity).alias("entity"), F.col(key).cast("long").alias("entity_id"), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))
        out = v if out is None else out.unionByName(v)
    return out


def _p4_sql(entity: str, table: str, key: str, attrs: str, required: str) -> str:
    return f"""SELECT '{entity}' AS entity, CAST({key} AS BIGINT) AS entity_id, strftime(valid_from, '%Y-%m-%d') AS valid_from,
  coalesce(strftime(lead(valid_from) OVER (PARTITION BY {key} ORDER BY valid_from), '%Y-%m-%d'), '9999-12-31') AS valid_to
FROM (SELECT {key}, snapshot_date AS valid_from, v, lag(v) OVER w AS before, row_number() OVER w AS n FROM (
    SELECT {key}, snapshot_date, arg_max(ROW({attrs}), updated_at) AS v FROM {table} WHERE {required} IS NOT NULL GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY {key} ORDER BY snapshot_date)) WHERE n = 1 OR v IS DISTINCT FROM before"""


P4_SQL = _p4_sql("manager", "managers", "manager_id", "team_id, season_start, season_end", "team_id") + "\nUNION ALL\n" + _p4_sql("team", "teams", "team_id", "venue_id, 0", "venue_id")


def p4_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slow satellites: versions of names, with their periods; uneven case and blanks are no change."""
    out = None
    for entity, table, key, name in (("manager", "managers", "manager_id", "full_name"), ("team", "teams", "team_id", "team_name")):
        df = read(spark, sf_dir, table).select(key, "snapshot_date", "updated_at", F.upper(F.trim(F.regexp_replace(name, r"\s+", " "))).alias("name"))
        df = df.withColumn("name", F.when(F.col("name") != "", F.col("name")))
        v = history.history(df, key, "snapshot_date", "updated_at", ["name"], ["name"])
        v = v.select(F.lit(entity).alias("entity"), F.col(key).cast("long").alias("entity_id"), "name", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))
        out = v if out is None else out.unionByName(v)
    return out


def p4_change_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each attribute changes from snapshot to snapshot: what the satellites' grouping rests on."""
    out = None
    for entity, (table, key, groups, required) in ENTITIES.items():
        attributes = [a for g in groups.values() for a in g]
        need = required["assignment" if entity == "manager" else "venue"]
        rates = history.change_rates(history.counted_snapshots(read(spark, sf_dir, table), key, "snapshot_date", "updated_at", attributes, need), key, "snapshot_date", attributes)
        rates = rates.select(F.lit(entity).alias("entity"), "attribute", "n_steps", "n_changes")
        out = rates if out is None else out.unionByName(rates)
    return out


QUERIES = {
    "p1_found": p1_found, "p1_offers": _flat("offer"), "p1_participants": _flat("participant"), "p1_players": _flat("player"), "p1_teams": _flat("team"), "p1_selections": _flat("selection"), "p1_opening_lines": _flat("opening_line"),
    "p1_books": _flat("book"), "p1_lines": _flat("line"), "p2_found": p2_found, "p2_inferred_conventions": p2_inferred_conventions, "p3_found": p3_found, "p3_as_known_rates": p3_as_known_rates, "p4_found": p4_found,
    "p4_identities": p4_identities, "p4_change_rates": p4_change_rates,
}
P3_RATES_SQL = f"""WITH found AS ({P3_SQL}), rates AS (SELECT DISTINCT metric_id, k_rate, 'batter' AS side FROM batter_season_metrics WHERE k_rate IS NOT NULL)
SELECT side, count(*) AS n_known, round(avg(k_rate), 6) AS mean_k_rate FROM found LEFT JOIN rates USING (side, metric_id) GROUP BY 1"""


def _identity_sql(entity: str, table: str, key: str, name: str) -> str:
    return f"""SELECT '{entity}' AS entity, CAST(k AS BIGINT) AS entity_id, v AS name, strftime(d, '%Y-%m-%d') AS valid_from, coalesce(strftime(lead(d) OVER (PARTITION BY k ORDER BY d), '%Y-%m-%d'), '9999-12-31') AS valid_to
FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY d) AS before FROM (SELECT {key} AS k, snapshot_date AS d, arg_max(n, ROW(updated_at, n)) AS v FROM (
  SELECT *, nullif(upper(trim(regexp_replace({name}, '\\s+', ' ', 'g'))), '') AS n FROM {table}) WHERE n IS NOT NULL AND {key} IS NOT NULL AND snapshot_date IS NOT NULL GROUP BY 1, 2)) WHERE before IS NULL OR v <> before"""


P4_IDENTITIES_SQL = _identity_sql("manager", "managers", "manager_id", "full_name") + "\nUNION ALL\n" + _identity_sql("team", "teams", "team_id", "team_name")


def _rates_sql(entity: str) -> str:
    table, key, groups, required = ENTITIES[entity]
    attributes = [a for g in groups.values() for a in g]
    need = required["assignment" if entity == "manager" else "venue"][0]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("updated_at", *attributes))
    best = f"(SELECT {key} AS k, snapshot_date AS d, {', '.join(attributes)} FROM {table} WHERE {need} IS NOT NULL AND {key} IS NOT NULL AND snapshot_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key}, snapshot_date ORDER BY {order}) = 1)"
    names = f"(SELECT k, d, lag(1) OVER w AS step, {', '.join(f'x{i} IS DISTINCT FROM lag(x{i}) OVER w AS c{i}' for i in range(len(attributes)))} FROM (SELECT * FROM {best} AS b(k, d, {', '.join(f'x{i}' for i in range(len(attributes)))})) WINDOW w AS (PARTITION BY k ORDER BY d))"
    return "\nUNION ALL\n".join(f"SELECT '{entity}' AS entity, '{a}' AS attribute, count(*) AS n_steps, count(*) FILTER (WHERE c{i}) AS n_changes FROM {names} WHERE step = 1" for i, a in enumerate(attributes))


SQL = {"p3_found": P3_SQL, "p3_as_known_rates": P3_RATES_SQL, "p4_found": P4_SQL, "p4_identities": P4_IDENTITIES_SQL, "p4_change_rates": _rates_sql("manager") + "\nUNION ALL\n" + _rates_sql("team")}
