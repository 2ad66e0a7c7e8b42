"""Harmonic continuation: transitions, scoped counts, interpolated prediction and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.ngrams import classes_of
from tessitura.plans.register import query
from tessitura.plans.store import Store, table

#: States are the most frequent classes of each of these lengths.
LM_NS, STATES, TOP = (3, 4, 5), 1000, 10
#: Length of the registered requests.
N = 3
#: Prior weight of each scope; a scope's support s counts s / (s + 50).
PRIORS = {"artist": 0.45, "genre": 0.25, "decade": 0.2, "global": 0.1}
HALF = 50

table("states", f"SELECT n, hkey, cnt FROM (SELECT n, hkey, cnt, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, hkey) AS r FROM harm WHERE n IN {LM_NS}) x WHERE r <= {STATES}")


@table("sequences", duck="SELECT w.song_id, w.n, row_number() OVER (PARTITION BY w.song_id, w.n ORDER BY w.pos) - 1 AS position, w.hkey FROM win w JOIN states s ON w.n = s.n AND w.hkey = s.hkey")
def sequences(store: Store) -> DataFrame:
    """Windows of the states, met on packed keys."""
    at = classes_of(store, store.table("states").select("n", "hkey"), LM_NS)
    place = F.row_number().over(Window.partitionBy("song_id", "n").orderBy("pos")) - 1
    return at.select("song_id", "n", place.alias("position"), "hkey")


table("transitions", """SELECT x.song_id, CASE WHEN x.song_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, x.n, x.position, x.hkey AS source, x.target, CAST(s.decade AS STRING) AS decade, s.main_genre, s.artist_id
    FROM (SELECT song_id, n, position, hkey, lead(hkey) OVER (PARTITION BY song_id, n ORDER BY position) AS target FROM sequences) x JOIN songs s ON x.song_id = s.song_id WHERE x.target IS NOT NULL""")  # fmt: skip

_SCOPED = """SELECT split, n, source, target, scope, value, count(*) AS cnt FROM (SELECT t.*, z.scope, CASE z.scope WHEN 'global' THEN 'all' WHEN 'decade' THEN t.decade WHEN 'genre' THEN t.main_genre ELSE t.artist_id END AS value
    FROM transitions t CROSS JOIN (VALUES ('global'), ('decade'), ('genre'), ('artist')) z(scope)) x WHERE value IS NOT NULL GROUP BY split, n, source, target, scope, value"""
table("transition_counts", _SCOPED)
table("source_support", "SELECT split, n, source, scope, value, CAST(sum(cnt) AS BIGINT) AS source_count FROM transition_counts GROUP BY split, n, source, scope, value")
table("unigrams", "SELECT n, target, sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY n) AS p FROM transition_counts WHERE split = 'train' AND scope = 'global' GROUP BY n, target")
table("unigram", f"SELECT n, target, p FROM unigrams WHERE n = {N}", view=True)


def mixture(requests: str) -> str:
    """Distributions p(target) for requests(rid, n, source, scope, value): scope weights prior * s / (s + 50) (global: the prior),
    renormalised over the scopes that know the source; unknown sources fall back to the unigram distribution."""
    prior = "CASE r.scope " + " ".join(f"WHEN '{s}' THEN CAST({p} AS DOUBLE)" for s, p in PRIORS.items()) + " END"
    weighted = f"SELECT r.rid, r.n, r.source, r.scope, r.value, s.source_count, {prior} * CASE WHEN r.scope = 'global' THEN 1.0 ELSE s.source_count / (s.source_count + {HALF}) END AS w FROM ({requests}) r JOIN source_support s ON s.split = 'train' AND s.n = r.n AND s.source = r.source AND s.scope = r.scope AND s.value = r.value"
    return f"""SELECT m.rid, c.target, sum(m.w / t.total * c.cnt / m.source_count) AS p FROM ({weighted}) m JOIN (SELECT rid, sum(w) AS total FROM ({weighted}) k GROUP BY rid) t ON m.rid = t.rid
        JOIN transition_counts c ON c.split = 'train' AND c.n = m.n AND c.source = m.source AND c.scope = m.scope AND c.value = m.value GROUP BY m.rid, c.target
        UNION ALL SELECT q.rid, u.target, u.p FROM (SELECT DISTINCT a.rid, a.n FROM ({requests}) a WHERE NOT EXISTS (SELECT 1 FROM ({weighted}) b WHERE b.rid = a.rid)) q JOIN unigrams u ON u.n = q.n"""


def request(rid: str, source: str, artist: str | None, genre: str | None, decade: str | None) -> str:
    rows = [("global", "'all'"), *((k, v) for k, v in (("artist", artist), ("genre", genre), ("decade", decade)) if v)]
    return " UNION ALL ".join(f"SELECT {rid} AS rid, {N} AS n, {source} AS source, '{k}' AS scope, {v} AS value" for k, v in rows)


_FIRST = f"(SELECT hkey FROM states WHERE n = {N} ORDER BY cnt DESC, hkey LIMIT 1)"
_ONE = request("1", _FIRST, "'src0'", "'en'", "'1950'")
query("transition_events", "SELECT song_id, split, n, position, source, target, decade, main_genre, artist_id FROM transitions")
query("harmonic_sequence", "SELECT song_id, n, position, hkey FROM sequences")
query("agg_transitions", "SELECT split, scope, value, n, source, target, cnt FROM transition_counts")
query("agg_source_support", "SELECT split, scope, value, n, source, source_count FROM source_support")
query("agg_scope_summary", "SELECT split, scope, count(DISTINCT value) AS vals, CAST(sum(cnt) AS BIGINT) AS events FROM transition_counts GROUP BY split, scope")
query("agg_unigram", "SELECT n, target, round(p, 10) AS p FROM unigrams")
query("lm_predict", f"SELECT target, round(p, 8) AS p FROM ({mixture(_ONE)}) d")
query("lm_top_predictions", f"SELECT target, p FROM (SELECT target, round(p, 8) AS p FROM ({mixture(_ONE)}) d) e ORDER BY p DESC, target LIMIT {TOP}")
query("lm_suggest_next", f"SELECT e.target, h.example, e.p FROM (SELECT target, round(p, 8) AS p FROM ({mixture(_ONE)}) d ORDER BY round(p, 8) DESC, target LIMIT 5) e JOIN harm h ON h.n = {N} AND h.hkey = e.target")
query("lm_unknown_source", f"SELECT target, round(p, 8) AS p FROM ({mixture(request('1', chr(39) + 'none' + chr(39), None, None, None))}) d")
query("lm_style_compare", f"""SELECT rid, target, p FROM (SELECT rid, target, round(p, 8) AS p, row_number() OVER (PARTITION BY rid ORDER BY round(p, 8) DESC, target) AS r FROM ({mixture(" UNION ALL ".join(request(str(i), _FIRST, None, f"'{g}'", None) for i, g in enumerate(("en", "fr", "de"))))}) d) x WHERE r <= 5""")
query("lm_artist_support", "SELECT value AS artist, source, source_count FROM source_support WHERE split = 'train' AND scope = 'artist' AND source_count >= 10")

table("lm_events", "SELECT song_id, n, position, source, target, decade, main_genre, artist_id, concat_ws('|', source, artist_id, main_genre, decade) AS rid FROM transitions WHERE split = 'test'", view=True)
#: Each distinct condition is mixed once; events join its distribution.
table("lm_conditions", "SELECT rid, n, source, min(artist_id) AS artist_id, min(main_genre) AS main_genre, min(decade) AS decade FROM lm_events GROUP BY rid, n, source")
table("lm_distributions", mixture("SELECT c.rid, c.n, c.source, z.scope, CASE z.scope WHEN 'global' THEN 'all' WHEN 'decade' THEN c.decade WHEN 'genre' THEN c.main_genre ELSE c.artist_id END AS value FROM lm_conditions c CROSS JOIN (VALUES ('global'), ('decade'), ('genre'), ('artist')) z(scope)"))
#: Test events of a source that one task scores before the source is split.
SOURCE_EVENTS = 20_000


def score_targets(events: DataFrame, counts: DataFrame, states: DataFrame, unigrams: DataFrame, source_events: int = SOURCE_EVENTS) -> DataFrame:
    """song_id, n, position, place and p of each event: the probability of its target under its condition and one more than the number
    of targets that are better (p rounded to nine digits, then the key), 999999 for a target the condition does not know.

    States are numbered, at most ``STATES`` a length. Events of a source meet its scopes' counts, one row of numbered targets for each
    (source, scope, value), in one place; a source with many events is split by song, and each part receives the rows that its events name.
    There a condition's distribution is one vector that lives as long as its group: nothing of conditions x targets is written or joined.
    ``unigrams`` (at most ``STATES`` rows a length) and ``states`` are the only tables sent to all tasks.
    """
    ids = states.select("n", "hkey", (F.row_number().over(Window.partitionBy("n").orderBy("hkey")) - 1).cast("int").alias("t"))
    wide = ids.groupBy("n").count().agg(F.max("count")).first()[0] or 0
    background: dict[int, np.ndarray] = {}
    for r in unigrams.join(ids, (unigrams["n"] == ids["n"]) & (unigrams["target"] == ids["hkey"])).select(ids["n"], "t", "p").collect():
        background.setdefault(r["n"], np.zeros(wide))[r["t"]] = r["p"]

    numbered = F.broadcast(ids.withColumnRenamed("hkey", "target"))
    parts = events.groupBy("n", "source").agg(F.ceil(F.count("*") / source_events).cast("int").alias("parts"))  # a row a state
    scopes = {"artist": "artist_id", "decade": "decade", "genre": "main_genre", "global": None}
    asked = events.join(numbered, ["n", "target"]).join(F.broadcast(parts), ["n", "source"])
    asked = asked.select("n", "source", F.pmod(F.xxhash64("song_id"), "parts").cast("int").alias("part"), "song_id", "position", "t", *(c for c in scopes.values() if c))
    names = F.array(*(F.struct(F.lit(k).alias("scope"), (F.col(c) if c else F.lit("all")).alias("value")) for k, c in scopes.items()))
    wanted = asked.select("n", "source", "part", F.explode(names).alias("s")).select("n", "source", "part", "s.*").where("value IS NOT NULL").distinct()
    known = counts.where("split = 'train'").join(numbered, ["n", "target"]).groupBy("n", "source", "scope", "value").agg(F.collect_list(F.struct("t", "cnt")).alias("c"))
    known = known.select("n", "source", "scope", "value", F.transform("c", lambda x: x["t"]).alias("ts"), F.transform("c", lambda x: x["cnt"]).alias("cs"))
    # First the counts of a group, then its events.
    vectors = wanted.join(known, ["n", "source", "scope", "value"]).withColumn("kind", F.lit(0))
    both = vectors.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order = ["n", "source", "part", "kind"]
    columns = [*order, "scope", "value", "ts", "cs", "song_id", "position", "t", "artist_id", "decade", "main_genre"]
    dealt = both.select(columns).repartition("n", "source", "part").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, mixed = None, {}, {}

        def mixture_of(n: int, condition: tuple) -> np.ndarray:
            if condition not in mixed:
                found = [(k, held[k, v]) for k, v in zip(("artist", "decade", "genre", "global"), (*condition, "all"), strict=True) if (k, v) in held]
                if len(mixed) >= 4096:
                    mixed.clear()
                if found:
                    totals = [float(c.sum()) for _, (_, c) in found]
                    weights = [PRIORS[k] * (1.0 if k == "global" else total / (total + HALF)) for (k, _), total in zip(found, totals, strict=True)]
                    p = np.zeros(wide)
                    for (_, (t, c)), w, total in zip(found, weights, totals, strict=True):
                        p[t] += w / sum(weights) * c / total
                else:
                    p = background.get(n, np.zeros(wide))
                mixed[condition] = p, np.where(p > 0, np.floor(p * 1e9 + 0.5), -1.0)
            return mixed[condition]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if group != (key := (r["n"], r["source"], r["part"])):
                    group, held, mixed = key, {}, {}
                if r["kind"] == 0:
                    held[r["scope"], r["value"]] = np.asarray(r["ts"], np.int64), np.asarray(r["cs"], np.float64)
                    continue
                p, rank = mixture_of(r["n"], (r["artist_id"], r["decade"], r["main_genre"]))
                t = r["t"]
                place = 1 + int(np.count_nonzero(rank > rank[t])) + int(np.count_nonzero(rank[:t] == rank[t])) if p[t] > 0 else 999999
                out.append((r["song_id"], r["n"], r["position"], place, max(float(p[t]), 1e-12)))
            if out:
                song, n, position, place, p = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(song, pa.int64()), pa.array(n, pa.int32()), pa.array(position, pa.int64()), pa.array(place, pa.int64()), pa.array(p)], names=["song_id", "n", "position", "place", "p"])

    return dealt.mapInArrow(run, "song_id long, n int, position long, place long, p double")


@table("lm_scored", duck="""SELECT e.song_id, e.n, e.position, coalesce(d.place, 999999) AS place, greatest(coalesce(d.p, 0.0), 0.000000000001) AS p FROM lm_events e
    LEFT JOIN (SELECT rid, target, p, CAST(row_number() OVER (PARTITION BY rid ORDER BY round(p, 9) DESC, target) AS BIGINT) AS place FROM lm_distributions) d ON d.rid = e.rid AND d.target = e.target""")
def lm_scored(store: Store) -> DataFrame:
    return score_targets(store.table("lm_events"), store.table("transition_counts"), store.table("states"), store.table("unigrams"))


query("lm_score_events", "SELECT song_id, n, position, place, round(p, 8) AS p, round(abs(ln(p)), 5) AS nll FROM lm_scored")
query("agg_eval_metrics", "SELECT n, count(*) AS events, round(avg(CAST(place <= 1 AS INT)), 6) AS top1, round(avg(CAST(place <= 5 AS INT)), 6) AS top5, round(avg(CAST(place <= 10 AS INT)), 6) AS top10, round(avg(1 / place), 6) AS mrr, round(avg(abs(ln(p))), 5) AS nll FROM lm_scored GROUP BY n")
