"""Pacing by domain and session health: folds over ordered signals, with the time as an argument.

A fold's result depends on the order of a key's signals, so a key's signals meet in one task. Its state is a few numbers,
and signals stream through it batch by batch: a group of any size needs the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_MS, MAX_MS = 2_000, 60_000
MAX_DOMAINS = 100


@dataclass
class Backoff:
    """Of a domain: until when it's held back, until when signals count on, how many there were; and its crawl delay."""

    until: int = 0
    decays: int = 0
    n: int = 0
    interval: int = 0
    next_fetch: int = 0

    def rate_limited(self, now: int, wait: int | None = None, base: int = BASE_MS, most: int = MAX_MS) -> bool:
        """A 429: backs off for base * 2^(n-1), or what the server asks for, `most` at most. Ignored while backing off; the
        count begins anew once the backoff has been over for as long as it lasted."""
        if now < self.until:
            return False
        if now >= self.decays:
            self.n = 0
        self.n += 1
        delay = min(wait if wait else base * 2 ** min(self.n - 1, 40), most)
        self.until = now + delay
        self.decays = self.until + delay
        return True

    def min_interval(self, interval: int) -> None:
        """A crawl delay: the first one declared holds."""
        self.interval = self.interval or interval

    def ready(self, now: int) -> bool:
        return now >= max(self.until, self.next_fetch)

    def fetched(self, now: int, least: int = 0) -> None:
        if delay := max(self.interval, least):
            self.next_fetch = now + delay


BACKOFF = "domain string, at_ms bigint, kind string, applied boolean, n int, until_ms bigint, next_fetch_ms bigint"


def _fold(state: Backoff, kind: str, now: int, wait: int | None, interval: int | None) -> bool:
    if kind == "rate_limited":
        return state.rate_limited(now, wait)
    if kind == "min_interval":
        before = state.interval
        state.min_interval(interval or 0)
        return before == 0 and state.interval > 0
    if kind == "fetch":
        ready = state.ready(now)
        if ready:
            state.fetched(now)
        return ready
    return False


#: Of each domain the state after all signals so far.
BACKOFF_STATE = "domain string, until bigint, decays bigint, n int, gap bigint, next_fetch bigint"
_STATE = [c.split()[0] for c in BACKOFF_STATE.split(", ")][1:]


def backoff_fold(signals: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """backoff_states() that goes on from `states` (BACKOFF_STATE), with a last row a domain without at_ms, whose `state` is
    where the next fold goes on from."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, state = None, Backoff()

        def last() -> tuple:
            return domain, None, None, None, None, None, None, dict(zip(_STATE, (state.until, state.decays, state.n, state.interval, state.next_fetch)))

        def out(rows: list[tuple]) -> pd.DataFrame:
            f = pd.DataFrame(rows, columns=["domain", "at_ms", "kind", "applied", "n", "until_ms", "next_fetch_ms", "state"], dtype=object)
            return f.assign(**{c: f[c].astype("Int64") for c in ("at_ms", "n", "until_ms", "next_fetch_ms")})

        for f in frames:
            rows = []
            for d, at, kind, wait, interval, before in zip(f["domain"], f["at_ms"], f["kind"], f["wait_ms"], f["interval_ms"], f["state"]):
                if d != domain:
                    if domain is not None:
                        rows.append(last())
                    domain, state = d, Backoff()
                if before is not None:
                    state = Backoff(*(before[c] for c in _STATE))
                    continue
                done = _fold(state, kind, int(at), None if pd.isna(wait) else int(wait), None if pd.isna(interval) else int(interval))
                rows.append((d, int(at), kind, done, state.n, state.until, state.next_fetch, None))
            yield out(rows)
        if domain is not None:
            yield out([last()])

    kind = f"struct<{', '.join(BACKOFF_STATE.split(', ')[1:]).replace(' bigint', ': bigint').replace(' int', ': int')}>"
    x = signals.where("domain is not null and at_ms is not null").select("domain", "at_ms", "seq", "kind", "wait_ms", "interval_ms", F.lit(None).cast(kind).alias("state"))
    if states is not None:
        own = states.join(x.select("domain").distinct(), "domain", "left_semi").select("domain", F.struct(*_STATE).alias("state"))
        x = x.unionByName(own, allowMissingColumns=True)
    ordered = x.repartition("domain").sortWithinPartitions("domain", F.col("state").isNull(), "at_ms", "seq")
    return ordered.mapInPandas(run, f"{BACKOFF}, state {kind}")


def backoff_states(signals: DataFrame) -> DataFrame:
    """The state after each signal (domain, at_ms, seq, kind, wait_ms, interval_ms), in the order of at_ms and seq.

    Domains are spread over the tasks and each task walks its sorted rows once; the state is reset where the domain changes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, state = None, Backoff()
        for f in frames:
            rows = []
            for d, at, kind, wait, interval in zip(f["domain"], f["at_ms"], f["kind"], f["wait_ms"], f["interval_ms"]):
                if d != domain:
                    domain, state = d, Backoff()
                done = _fold(state, kind, int(at), None if pd.isna(wait) else int(wait), None if pd.isna(interval) else int(interval))
                rows.append((d, int(at), kind, done, state.n, state.until, state.next_fetch))
            yield pd.DataFrame(rows, columns=["domain", "at_ms", "kind", "applied", "n", "until_ms", "next_fetch_ms"])

    x = signals.where("domain is not null and at_ms is not null").select("domain", "at_ms", "seq", "kind", "wait_ms", "interval_ms")
    return x.repartition("domain").sortWithinPartitions("domain", "at_ms", "seq").mapInPandas(run, BACKOFF)


def fetchable(domains: DataFrame, now_ms: int) -> DataFrame:
    """Domains (domain, until_ms, next_fetch_ms, first_seen) that may be fetched now, longest waiting first."""
    ready = F.greatest("until_ms", "next_fetch_ms")
    return domains.where(ready <= now_ms).orderBy(ready, "first_seen")


def domain_limit(domains: DataFrame, most: int = MAX_DOMAINS) -> None:
    """Raises if more domains are held back than may be."""
    if domains.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} domains are throttled")


def throttled_alias(domain: str) -> str:
    """The name of a held-back domain's own queue."""
    from urllib.parse import quote

    return f"throttled-{quote(domain, safe="-_.!~*'()")}"


# --- sessions ----------------------------------------------------------------------------------------------------------


@dataclass
class Session:
    usage: int = 0
    score: float = 0.0
    retired: bool = False

    def good(self) -> None:
        self.usage += 1
        self.score = max(0.0, self.score - 0.5)

    def bad(self) -> None:
        self.usage += 1
        self.score += 1

    def retire(self) -> None:
        self.usage += 1
        self.retired = True

    def usable(self, age_s: float = 0, max_score: float = 3, max_usage: int = 50, max_age_s: float = 3_000) -> bool:
        return not self.retired and self.score < max_score and self.usage < max_usage and age_s < max_age_s


SESSION = "session_id string, usage int, score double, retired boolean, usable boolean"


def session_states(outcomes: DataFrame) -> DataFrame:
    """The final state of each session from its outcomes (session_id, seq, outcome: good, bad, retire)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s, rows = None, Session(), []

        def row() -> tuple:
            return key, s.usage, s.score, s.retired, s.usable()

        for f in frames:
            for k, o in zip(f["session_id"], f["outcome"]):
                if k != key:
                    if key is not None:
                        rows.append(row())
                    key, s = k, Session()
                {"good": s.good, "bad": s.bad, "retire": s.retire}[o]()
            yield pd.DataFrame(rows, columns=["session_id", "usage", "score", "retired", "usable"])
            rows = []
        if key is not None:
            yield pd.DataFrame([row()], columns=["session_id", "usage", "score", "retired", "usable"])

    x = outcomes.where("session_id is not null and outcome in ('good', 'bad', 'retire')").select("session_id", "seq", "outcome")
    return x.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, SESSION)


def pool_counts(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count_if("usable").alias("usable"), F.count_if("retired").alias("retired"))


#: The members of a stored session, in their order, and the column and type of each.
SESSION_RECORD = {
    "id": "session_id string", "cookieJar": "cookie_jar string", "proxyInfo": "proxy_info string", "userData": "user_data string", "fingerprint": "fingerprint string",
    "maxErrorScore": "max_error_score double", "errorScoreDecrement": "error_score_decrement double", "expiresAt": "expires_at timestamp", "createdAt": "created_at timestamp",
    "usageCount": "usage int", "maxUsageCount": "max_usage int", "errorScore": "score double", "retired": "retired boolean",
}
_JSON = ("cookieJar", "proxyInfo", "userData", "fingerprint")
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def sessions_record(sessions: DataFrame, created_at: Column | None = None, max_score: float = 3, decrement: float = 0.5, max_usage: int = 50, max_age_s: int = 3_000) -> DataFrame:
    """(session_id, record): usable sessions as JSON, those that aren't are not kept. Limits and times are the columns' or the
    arguments'; what a session doesn't have is null, its user data and cookies empty."""
    x = sessions.where("usable")

    def own(name: str, default: Column) -> Column:
        return F.coalesce(name, default) if name in x.columns else default

    created = own("created_at", created_at if created_at is not None else F.current_timestamp())
    expires = own("expires_at", created + F.make_dt_interval(secs=F.lit(max_age_s)))
    none = F.lit(None).cast("string")
    values = {
        "id": F.to_json(F.struct(F.col("session_id").alias("x"))), "cookieJar": own("cookie_jar", F.lit('{"cookies":[]}')), "proxyInfo": own("proxy_info", none), "userData": own("user_data", F.lit("{}")),
        "fingerprint": own("fingerprint", none), "maxErrorScore": own("max_error_score", F.lit(float(max_score))), "errorScoreDecrement": own("error_score_decrement", F.lit(decrement)),
        "expiresAt": F.date_format(expires, _ISO), "createdAt": F.date_format(created, _ISO), "usageCount": F.col("usage"), "maxUsageCount": own("max_usage", F.lit(max_usage)),
        "errorScore": F.col("score"), "retired": F.col("retired"),
    }
    texts = []
    for name, v in values.items():
        text = F.regexp_extract(v, r'^\{"x":(.*)\}$', 1) if name == "id" else F.concat(F.lit('"'), v, F.lit('"')) if name.endswith("At") else v.cast("string")
        texts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(text, F.lit("null"))))
    return x.select("session_id", F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}")).alias("record"))


def restore_sessions(records: DataFrame, now: Column | None = None, max_score: float = 3, decrement: float = 0.5, max_usage: int = 50) -> DataFrame:
    """Sessions from their records, with `usable` at the time `now`; a record without id or a readable time gives no row."""
    ddl = ", ".join(f"`{n}` {'string' if kind.endswith('timestamp') else kind.split()[1]}" for n, kind in SESSION_RECORD.items())
    x = records.select(F.from_json("record", ddl).alias("j"), F.col("record"))
    parts = []
    for n, kind in SESSION_RECORD.items():
        name, of = kind.split()
        c = F.get_json_object("record", f"$.{n}") if n in _JSON else F.try_to_timestamp(f"j.{n}") if of == "timestamp" else F.col(f"j.{n}")
        parts.append(c.alias(name))
    x = x.select(*parts).where("session_id is not null and created_at is not null and expires_at is not null")
    filled = {"max_error_score": F.lit(float(max_score)), "error_score_decrement": F.lit(decrement), "max_usage": F.lit(max_usage), "usage": F.lit(0), "score": F.lit(0.0), "retired": F.lit(False), "user_data": F.lit("{}")}
    x = x.withColumns({c: F.coalesce(c, v) for c, v in filled.items()})
    at = now if now is not None else F.current_timestamp()
    return x.withColumn("usable", ~F.col("retired") & (F.col("score") < F.col("max_error_score")) & (F.col("usage") < F.col("max_usage")) & (at < F.col("expires_at")))


def pick_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """`requests` with `session`: their own if it's usable, else one of the pool by the request's hash."""
    usable = sessions.where("usable").select(F.col("session_id").alias("_sid"))
    pool = usable.agg(F.sort_array(F.collect_list("_sid")).alias("_pool"))  # at most the pool's size, 1,000 by default
    x = requests.join(usable, requests["session_id"] == usable["_sid"], "left").crossJoin(F.broadcast(pool))
    n = F.size("_pool")
    own = F.when(n > 0, F.element_at("_pool", (F.pmod(F.xxhash64("id"), n) + 1).cast("int")))
    return x.withColumn("session", F.coalesce("_sid", own)).drop("_sid", "_pool")
