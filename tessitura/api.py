"""The request surface: bounded parameters in, DataFrames (or JSON rows) out, over one store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators import similarity as sim
from tessitura.plans.store import Store
from tessitura.sources.songs import json_rows

ROUTES = {}


class ApiError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status, self.message = status, message


def route(path: str):
    def add(f):
        ROUTES[path] = f
        return f

    return add


def _flag(params: dict, name: str) -> bool:
    return str(params.get(name, "")).lower() in ("1", "true", "yes", "on")


def _song(store: Store, value) -> int:
    try:
        song = int(value)
    except (TypeError, ValueError) as e:
        raise ApiError(400, "song_id must be an integer") from e
    if store.table("songs").where(F.col("song_id") == song).isEmpty():
        raise ApiError(404, f"no song {song}")
    return song


def _lengths(params: dict) -> dict[int, float]:
    try:
        return sim.parse_weights(params.get("weights"), sim.parse_ns(params.get("ns")))
    except sim.ParameterError as e:
        raise ApiError(400, str(e)) from e


@route("/api/health")
def health(store: Store, params: dict) -> DataFrame:
    return store.spark.createDataFrame([("ok", store.folder, len(store.kept))], "status string, store string, tables int")


@route("/api/stats")
def stats(store: Store, params: dict) -> DataFrame:
    return store.sql("SELECT n, count(*) AS songs, sum(total_windows) AS windows, sum(uniq) AS features, sum(indexed) / sum(total_windows) AS coverage FROM totals GROUP BY n")


@route("/api/search")
def search(store: Store, params: dict) -> DataFrame:
    links = params.get("spotify", "all")
    if links not in ("all", "only", "prefer"):
        raise ApiError(400, "spotify must be all, only or prefer")
    return sim.search_songs(store, params.get("q", ""), sim.bounded_int(params.get("limit"), 20, 1, 50), links)


@route("/api/spotify")
def track_metadata(store: Store, params: dict) -> DataFrame:
    """The cached title and artist of a track."""
    if not (track := params.get("spotify_song_id", "").strip()):
        raise ApiError(400, "spotify_song_id is missing")
    rows = store.table("track_meta").where(F.col("track_id") == track)
    if rows.isEmpty():
        raise ApiError(404, f"no metadata of {track}")
    return rows


@route("/api/song")
@route("/api/chords")
def song(store: Store, params: dict) -> DataFrame:
    number = _song(store, params.get("song_id"))
    excerpt = F.concat(F.array_join(F.slice("tokens", 1, 24), " "), F.when(F.size("tokens") > 24, " ...").otherwise(""))
    return store.table("songs").where(F.col("song_id") == number).withColumn("excerpt", excerpt)


@route("/api/similar")
def similar(store: Store, params: dict) -> DataFrame:
    number, weights = _song(store, params.get("song_id")), _lengths(params)
    column = params.get("weight_column", "tfidf_log_count")
    if column not in sim.WEIGHTS:
        raise ApiError(400, f"weight_column must be one of {sorted(sim.WEIGHTS)}")
    top, shared = sim.bounded_int(params.get("top_k"), 20, 1, 100), sim.bounded_int(params.get("min_shared"), 4, 1, 500)
    filters = {"exclude_same_artist": _flag(params, "exclude_same_artist"), "cross_genre": _flag(params, "cross_genre")}
    if _flag(params, "exact"):
        return sim.asked(store, sim.similar_exact, number, weights, top, shared, column, **filters)
    pool = sim.bounded_int(params.get("candidate_pool"), max(12 * top, 1200), top, 10_000)
    features = sim.bounded_int(params.get("candidate_features"), 96, 16, 500)
    return sim.asked(store, sim.similar_fast, number, weights, top, shared, column, features, pool, sim.bounded_float(params.get("max_df_rate"), 0.05, 0.0, 1.0), **filters)


@route("/api/compare-n")
def compare(store: Store, params: dict) -> DataFrame:
    rate = None if _flag(params, "exact") else sim.bounded_float(params.get("max_df_rate"), 0.05, 0.0, 1.0)
    return sim.asked(store, sim.compare_n, _song(store, params.get("song_id")), tuple(_lengths(params)), sim.bounded_int(params.get("top_k"), 5, 1, 20), sim.bounded_int(params.get("min_shared"), 2, 1, 500), rate)


@route("/api/explain")
def explain(store: Store, params: dict) -> DataFrame:
    """Shared features; ``part`` may be by_n or unique_query instead."""
    a, b, weights = _song(store, params.get("song_id")), _song(store, params.get("candidate_id")), _lengths(params)
    top = sim.bounded_int(params.get("top_features"), 40, 1, 200)
    part = params.get("part", "features")
    if part == "by_n":
        return sim.asked(store, sim.explain_by_n, a, b, weights)
    return sim.asked(store, sim.explain_unique if part == "unique_query" else sim.explain_features, a, b, weights, top)


def handle(store: Store, path: str, params: dict) -> tuple[int, list[str]]:
    """Status and JSON rows of a request."""
    import json

    try:
        if path not in ROUTES:
            raise ApiError(404, f"no route {path}")
        return 200, [r["json"] for r in json_rows(ROUTES[path](store, params)).collect()]
    except ApiError as e:
        return e.status, [json.dumps({"error": e.message})]
    except sim.ParameterError as e:
        return 400, [json.dumps({"error": str(e)})]
