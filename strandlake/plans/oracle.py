"""The queries' SQL for DuckDB, put together from a few common table expressions."""

from __future__ import annotations

from .queries import GAP, GENOME, LARGE, LEAST, P_CUTOFF, Q_CUTOFF, Q_WEAK, SIZE, SMALL, WEAK

ITEMS = """items AS (
    SELECT l_returnflag AS chrom, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS pos,
           CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, CAST(l_quantity AS BIGINT) AS length,
           l_linenumber % 2 = 1 AS treated, CAST(l_linenumber AS BIGINT) AS cnt FROM lineitem)"""
SIDES = """t AS (SELECT chrom, pos, strand, count(*) AS n FROM items WHERE treated GROUP BY ALL),
    c AS (SELECT chrom, pos, strand, count(*) AS n FROM items WHERE NOT treated GROUP BY ALL)"""
SIGNALS = "items AS (SELECT event_type AS chrom, date_diff('minute', TIMESTAMP '2024-01-01', ts) AS pos FROM events)"
RUN = '"start", "end"'


def _extended(side: str, size: int = SIZE, shift: int = 0, where: str = "true") -> str:
    return f"""SELECT chrom, CASE WHEN strand = '+' THEN pos + ({shift}) ELSE pos - ({shift}) - {size} END AS s,
               CASE WHEN strand = '+' THEN pos + ({shift}) + {size} ELSE pos - ({shift}) END AS e, n AS w FROM {side} WHERE {where}"""


def _compacted(source: str, values: list[str]) -> str:
    same = " AND ".join(f"{v} IS NOT DISTINCT FROM lag({v}) OVER o" for v in values)
    kept = ", ".join(f"any_value({v}) AS {v}" for v in values)
    return f"""SELECT chrom, min("start") AS "start", max("end") AS "end", {kept} FROM (
        SELECT *, sum(b) OVER (PARTITION BY chrom ORDER BY "start") AS g FROM (
            SELECT *, CASE WHEN {same} AND "start" = lag("end") OVER o THEN 0 ELSE 1 END AS b FROM ({source})
            WINDOW o AS (PARTITION BY chrom ORDER BY "start"))) GROUP BY chrom, g"""


def _swept(events: str, names: list[str]) -> str:
    """Runs out of (chrom, pos, names...) events."""
    total = ", ".join(f"sum({n}) AS {n}" for n in names)
    running = ", ".join(f"CAST(sum({n}) OVER o AS BIGINT) AS {n}" for n in names)
    kept = ", ".join(names)
    return f"""SELECT chrom, "start", "end", {kept} FROM (
        SELECT chrom, pos AS "start", lead(pos) OVER o AS "end", {running} FROM (
            SELECT chrom, pos, {total} FROM ({events}) GROUP BY chrom, pos) WINDOW o AS (PARTITION BY chrom ORDER BY pos)) WHERE "end" IS NOT NULL"""


def _coverage(intervals: str) -> str:
    """Coverage of (chrom, s, e, w) from zero."""
    clipped = f"SELECT chrom, greatest(s, 0) AS s, e, w FROM ({intervals}) WHERE e > greatest(s, 0)"
    events = f"""SELECT chrom, s AS pos, w AS value FROM ({clipped}) UNION ALL SELECT chrom, e, -w FROM ({clipped})
        UNION ALL SELECT DISTINCT chrom, 0, 0 FROM ({clipped})"""
    return _compacted(_swept(events, ["value"]), ["value"])


def _enriched(control: bool = True, scale: str = "small", local: bool = True, pairs: bool = False) -> str:
    """CTEs tot (totals and scales) and both (treat, lambda), over t and c (or fragments tf and cf, both ends of which count half)."""
    widths = {"d": SIZE, "small": SMALL, "large": LARGE} if control else {"large": LARGE}
    names = ["treat", *widths]
    zeros = {n: ", ".join(f"{'w' if m == n else '0'} AS {m}" for m in names) for n in names}
    events = []
    pieces, side = _extended("t"), "c" if control else "t"
    treated, ends, share = "t", side, 1.0
    if pairs:
        pieces, treated, side, share = "SELECT chrom, l AS s, r AS e, n AS w FROM tf", "tf", f"{side}f", 0.5
        ends = f"(SELECT chrom, l AS pos, n FROM {side} UNION ALL SELECT chrom, r AS pos, n FROM {side})"
    sources = [("treat", f"SELECT chrom, greatest(s, 0) AS s, e, w FROM ({pieces})")]
    sources += [(n, f"SELECT chrom, greatest(pos - {w // 2}, 0) AS s, pos + {w - w // 2} AS e, n AS w FROM {ends}") for n, w in widths.items()]
    for n, q in sources:
        events.append(f"SELECT chrom, s AS pos, {zeros[n]} FROM ({q}) WHERE e > s")
        events.append(f"SELECT chrom, e AS pos, {zeros[n].replace('w AS', '-w AS')} FROM ({q}) WHERE e > s")
    events.append("SELECT DISTINCT chrom, 0, " + ", ".join("0" for _ in names) + f" FROM {treated}")
    total = f"(SELECT sum(n) FROM {side})"
    if not control:
        scales = "1.0::DOUBLE AS ts, 1.0::DOUBLE AS cs"
    elif scale == "small":
        scales = "CASE WHEN tn > cn THEN cn / tn ELSE 1.0 END::DOUBLE AS ts, CASE WHEN tn > cn THEN 1.0 ELSE tn / cn END::DOUBLE AS cs"
    else:
        scales = "CASE WHEN tn > cn THEN 1.0 ELSE cn / tn END::DOUBLE AS ts, CASE WHEN tn > cn THEN tn / cn ELSE 1.0 END::DOUBLE AS cs"
    base = f"cn * {SIZE}::DOUBLE / {GENOME}::DOUBLE * cs"
    rates = "".join(f", {n} * ({share}::DOUBLE * {SIZE} / {w} * cs)" for n, w in widths.items()) if local else ""
    runs = f"""SELECT r.chrom, "start", least("end", last) AS "end", treat * ts AS treat, greatest({base}{rates}) AS "lambda"
        FROM ({_swept(" UNION ALL ".join(events), names)}) r JOIN (SELECT chrom, max(e) AS last FROM ({pieces}) GROUP BY chrom) l ON r.chrom = l.chrom, tot
        WHERE "start" < last"""
    return f"""tot AS (SELECT tn, cn, {scales} FROM (SELECT (SELECT sum(n) FROM {treated})::DOUBLE AS tn, {total}::DOUBLE AS cn)),
    both_ AS ({_compacted(runs, ["treat", '"lambda"'])})"""


TAIL = "list_sum(list_transform(range(1, 400), lambda i: exp(-l + (k + i) * ln(l) - lgamma(k + i + 1))))"
SCORES = f"""pairs AS (SELECT k, l, round(-log10({TAIL}), 9) AS p FROM (SELECT DISTINCT floor(treat + 1e-9) AS k, "lambda" AS l FROM src)),
    withp AS (SELECT s.*, p, (treat + 1) / ("lambda" + 1) AS fe FROM src s JOIN pairs ON floor(treat + 1e-9) = k AND "lambda" = l),
    ranks AS (SELECT p, p + log10(1 + coalesce(sum(b) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) - log10(sum(b) OVER ()) AS raw
              FROM (SELECT p, sum("end" - "start") AS b FROM withp GROUP BY p)),
    qs AS (SELECT p, greatest(0, min(raw) OVER (ORDER BY p DESC)) AS q FROM ranks),
    scored AS (SELECT w.*, q FROM withp w JOIN qs USING (p))"""
BASE = f"WITH {ITEMS}, {SIDES}"
PAIRS = """tf AS (SELECT chrom, pos AS l, pos + length AS r, sum(cnt) AS n FROM items WHERE treated GROUP BY ALL),
    cf AS (SELECT chrom, pos AS l, pos + length AS r, sum(cnt) AS n FROM items WHERE NOT treated GROUP BY ALL)"""
SCORED = f"{BASE}, {_enriched()}, src AS (SELECT * FROM both_), {SCORES}"


def _islands(source: str, gap: int, by: str = "chrom") -> str:
    return f"""SELECT *, max(o) OVER (PARTITION BY {by} ORDER BY "start", "end") AS region FROM (
        SELECT *, CASE WHEN reach IS NULL OR "start" - reach > {gap} THEN "start" END AS o FROM (
            SELECT *, max("end") OVER (PARTITION BY {by} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source})))"""


def _narrow(score: str, cutoff: float) -> str:
    return f"""{SCORED}, isl AS ({_islands(f'SELECT * FROM scored WHERE {score} > {cutoff}', GAP)}),
    ends AS (SELECT chrom, region, min("start") AS "start", max("end") AS "end", max(treat) AS top FROM isl GROUP BY ALL),
    tops AS (SELECT i.chrom, i.region, i."start" AS s, i."end" AS e, i.treat AS pileup, i.p, i.fe, i.q, row_number() OVER o AS r, count(*) OVER (PARTITION BY i.chrom, i.region) AS n
             FROM isl i JOIN ends d ON i.chrom = d.chrom AND i.region = d.region AND i.treat = d.top WINDOW o AS (PARTITION BY i.chrom, i.region ORDER BY i."start")),
    narrow AS (SELECT d.chrom, d."start", d."end", (s + e) // 2 AS summit, pileup, p, fe, q FROM ends d JOIN tops t ON d.chrom = t.chrom AND d.region = t.region
               WHERE r = (n + 1) // 2 AND d."end" - d."start" >= {LEAST})"""


def _broad(score: str, weak: float) -> str:
    return f"""{SCORED}, low AS ({_islands(f'SELECT * FROM scored WHERE {score} > {weak}', 4 * GAP)}),
    wide AS (SELECT chrom, region, min("start") AS "start", max("end") AS "end", sum(treat * ("end" - "start")) / sum("end" - "start") AS pileup,
                    sum(p * ("end" - "start")) / sum("end" - "start") AS p, sum(fe * ("end" - "start")) / sum("end" - "start") AS fe, sum(q * ("end" - "start")) / sum("end" - "start") AS q
             FROM low GROUP BY ALL HAVING max("end") - min("start") >= {LEAST})"""


NARROW, BROAD = _narrow("p", P_CUTOFF), _broad("p", WEAK)
BLOCKS = f"""{BROAD}, core AS ({_islands(f'SELECT chrom, region AS outer_, "start", "end" FROM low WHERE p > {P_CUTOFF}', GAP, 'chrom, outer_')}),
    inner_ AS (SELECT chrom, outer_, region, min("start") AS s, max("end") AS e FROM core GROUP BY ALL HAVING max("end") - min("start") >= {LEAST}),
    parts AS (
        SELECT w.chrom, w.region, w."start" AS a, w."end" AS b, s, e FROM wide w JOIN inner_ i ON w.chrom = i.chrom AND w.region = i.outer_
        UNION SELECT chrom, region, "start", "end", "start", "start" + 1 FROM wide w WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.chrom = w.chrom AND i.outer_ = w.region AND i.s = w."start")
        UNION SELECT chrom, region, "start", "end", "end" - 1, "end" FROM wide w WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.chrom = w.chrom AND i.outer_ = w.region AND i.e = w."end"))"""
TRACKS = f"{BASE}, ta AS ({_coverage(_extended('t'))}), tb AS ({_coverage(_extended('c'))})"


def _aligned(names: dict[str, str]) -> str:
    """Runs on the union of the breakpoints of tracks (column: table), integer values."""
    events = []
    for n, table in names.items():
        columns = ", ".join(f"{'value' if m == n else '0'} AS {m}" for m in names)
        minus = ", ".join(f"{'-value' if m == n else '0'} AS {m}" for m in names)
        events += [f'SELECT chrom, "start" AS pos, {columns} FROM {table}', f'SELECT chrom, "end" AS pos, {minus} FROM {table}']
    return _swept(" UNION ALL ".join(events), list(names))


def _method(expression: str) -> str:
    runs = f'SELECT chrom, "start", "end", {expression} AS value FROM ({_aligned({"a": "ta", "b": "tb"})})'
    return f'{TRACKS} SELECT chrom, {RUN}, round(value::DOUBLE, 6) AS value FROM ({_compacted(runs, ["value"])})'


def _llr(x: str, y: str) -> str:
    return f"CASE WHEN {x} > {y} THEN 1 WHEN {x} < {y} THEN -1 ELSE 0 END * (({x} + 1.0::DOUBLE) * ln(({x} + 1.0::DOUBLE) / (({x} + {y} + 2.0::DOUBLE) / 2)) + ({y} + 1.0::DOUBLE) * ln(({y} + 1.0::DOUBLE) / (({x} + {y} + 2.0::DOUBLE) / 2))) / ln(10.0::DOUBLE)"


LOGLR = "CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END * ((a + 1.0::DOUBLE) * (ln(a + 1.0::DOUBLE) - ln(b + 1.0::DOUBLE)) + b - a) * CASE WHEN a = b THEN 0 ELSE 1 END / ln(10.0::DOUBLE)"
METHODS = {
    "subtract": "(a - b)::DOUBLE", "add": "(a + b)::DOUBLE", "multiply": "(a * b)::DOUBLE", "divide": "CASE WHEN b <> 0 THEN a::DOUBLE / b END", "max": "greatest(a, b)::DOUBLE",
    "min": "least(a, b)::DOUBLE", "mean": "(a + b)::DOUBLE / 2", "fe": "(a + 1.0::DOUBLE) / (b + 1.0::DOUBLE)", "logfe": "log10((a + 1.0::DOUBLE) / (b + 1.0::DOUBLE))",
    "loglr": LOGLR, "slogllr": _llr("a", "b"),
}

POISSON = f"""{TRACKS}, src AS (SELECT chrom, {RUN}, a::DOUBLE AS treat, b::DOUBLE AS "lambda" FROM ({_aligned({"a": "ta", "b": "tb"})})),
    pairs AS (SELECT k, l, CASE WHEN l <= 0 THEN 'infinity'::DOUBLE ELSE round(-log10({TAIL.replace("ln(l)", "ln(greatest(l, 1e-300))")}), 9) END AS p FROM (SELECT DISTINCT floor(treat + 1e-9) AS k, "lambda" AS l FROM src)),
    {SCORES[SCORES.index("withp AS"):]}"""
_STRANDS = {f"{k}{i}": _coverage(_extended("t" if k == "t" else "c", where=f"strand = '{s}'")) for i, s in ((1, "+"), (2, "-")) for k in "tc"}
DIFF = f"""{BASE}, {", ".join(f"tr_{n} AS ({q})" for n, q in _STRANDS.items())},
    told AS (SELECT chrom, "start", "end", {_llr("t1", "t2")} AS ratio, {_llr("t1", "c1")} AS s1, {_llr("t2", "c2")} AS s2 FROM ({_aligned({n: f"tr_{n}" for n in _STRANDS})})),
    kinds AS (SELECT *, CASE WHEN ratio >= 1 THEN CASE WHEN s1 >= 1 THEN 'cond1' END WHEN ratio <= -1 THEN CASE WHEN s2 >= 1 THEN 'cond2' END WHEN s1 >= 1 AND s2 >= 1 THEN 'common' END AS kind FROM told)
    SELECT kind, chrom, min("start") AS "start", max("end") AS "end", round(max(abs(ratio)), 4) AS score
    FROM ({_islands("SELECT * FROM kinds WHERE kind IS NOT NULL", GAP, "kind, chrom")}) GROUP BY kind, chrom, region HAVING max("end") - min("start") >= {LEAST}"""
LIMIT = f"""lim AS (SELECT greatest(1, min(x)) AS m FROM (
    SELECT x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(1 / {GENOME}) + (n - x) * ln(1 - 1 / {GENOME}))) OVER (ORDER BY x) AS cdf
    FROM (SELECT sum(n)::DOUBLE AS n FROM t), (SELECT unnest(range(0, 400)) AS x) WHERE x <= n) WHERE cdf >= 1 - 1e-5)"""
CUTS = " UNION ALL ".join(f"SELECT {c}::DOUBLE AS cutoff, * FROM scored WHERE p > {c}" for c in (0.5, 0.8, 1.0, 1.5))
CURVE = " UNION ALL ".join(f"SELECT {round(0.313 + 0.037 * k, 3)}::DOUBLE AS cutoff" for k in range(60))
PARTS = ((5.0, 3.0), (20.0, 5.0), (35.0, 5.0), (48.0, 3.0))
_DENSITY = [f"exp(-power(length - {m}, 2) / {2 * s * s}) / {s}" for m, s in PARTS]
#: Coverage of the treated reads base by base in each narrow peak, and the smoothed slope over five bases.
SLOPES = f"""{NARROW}, named AS (SELECT chrom, "start" AS a, "end" AS b, 'run_peak_' || row_number() OVER (ORDER BY chrom, "start") AS name FROM narrow),
    cov AS ({_coverage(_extended('t'))}), bases AS (SELECT *, unnest(range(a, b)) AS i FROM named),
    sig AS (SELECT bases.*, coalesce(value, 0) AS f FROM bases LEFT JOIN cov ON cov.chrom = bases.chrom AND i >= cov."start" AND i < cov."end"),
    slopes AS (SELECT *, 2 * (coalesce(lead(f, 2) OVER o, last_value(f) OVER o) - coalesce(lag(f, 2) OVER o, first_value(f) OVER o)) + coalesce(lead(f) OVER o, last_value(f) OVER o) - coalesce(lag(f) OVER o, first_value(f) OVER o) AS g
        FROM sig WINDOW o AS (PARTITION BY name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    turns AS (SELECT *, lead(g) OVER w AS ng, lead(f) OVER w AS nf FROM slopes WINDOW w AS (PARTITION BY name ORDER BY i)),
    found AS (SELECT chrom, a, b, name, CASE WHEN ng = 0 THEN i + 1 ELSE i END AS summit, CASE WHEN ng = 0 THEN nf ELSE f END AS height FROM turns WHERE g > 0 AND ng <= 0 AND b - a >= 3),
    whole AS (SELECT * FROM found UNION ALL SELECT chrom, a, b, name, i, f FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f DESC, i) AS r FROM sig) WHERE r = 1 AND name NOT IN (SELECT name FROM found))"""
_SHARES = ", ".join(f"CAST(round(d{i} / (d0 + d1 + d2 + d3) * 1000000) AS BIGINT) AS w{i}" for i in range(4))
BINNED = f"""WITH {ITEMS}, den AS (SELECT chrom, pos AS l, pos + length AS r, cnt, {", ".join(f"{x} AS d{i}" for i, x in enumerate(_DENSITY))} FROM items),
    parts AS (SELECT chrom, l, r, cnt, {_SHARES} FROM den WHERE r > l),
    bins AS (SELECT *, least(r, (bin + 1) * 4) - greatest(l, bin * 4) AS inside FROM (SELECT *, unnest(range(CAST(floor(l / 4) AS BIGINT), CAST(floor((r - 1) / 4) AS BIGINT) + 1)) AS bin FROM parts))
    SELECT chrom, bin, {", ".join(f"round(sum(w{i} * cnt * inside)::DOUBLE / 4000000, 8) AS s{i}" for i in range(4))} FROM bins GROUP BY chrom, bin"""
REFINED = f"""{NARROW}, hits AS (SELECT d.chrom, d."start" AS a, d."end" AS b, pos, n FROM narrow d JOIN t ON d.chrom = t.chrom AND pos >= d."start" AND pos < d."end"),
    ev AS (SELECT chrom, a, b, pos, sum(v) AS v FROM (SELECT chrom, a, b, pos - 3 AS pos, n AS v FROM hits UNION ALL SELECT chrom, a, b, pos + 3, -n FROM hits) GROUP BY ALL),
    rs AS (SELECT chrom, a, b, pos, lead(pos) OVER o AS nxt, sum(v) OVER o AS score FROM ev WINDOW o AS (PARTITION BY chrom, a, b ORDER BY pos))
    SELECT chrom, a AS "start", b AS "end", least(greatest(CAST(floor((nxt + pos) / 2) AS BIGINT), a), b - 1) AS summit, CAST(score AS BIGINT) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY chrom, a, b ORDER BY score DESC, pos) AS r FROM rs WHERE nxt IS NOT NULL) WHERE r = 1"""

ORACLE: dict[str, str] = {
    "read_stats": f"WITH {ITEMS} SELECT chrom, strand, count(*) AS n, round(avg(length), 6) AS mean_length, min(pos) AS first_pos, max(pos) AS last_pos FROM items GROUP BY ALL",
    "tag_size": f"WITH {ITEMS} SELECT CAST(floor(avg(length)) AS BIGINT) AS tag_size FROM items WHERE treated",
    "redundant_rate": f"{BASE} SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS kept, round(1 - count(*) / sum(n)::DOUBLE, 2) AS redundant_rate FROM t",
    "filterdup_1": f"{BASE} SELECT chrom, pos, strand, least(n, 1) AS n FROM t",
    "filterdup_all": f"{BASE} SELECT chrom, pos, strand, n FROM t",
    "filterdup_auto": f"{BASE}, {LIMIT} SELECT chrom, pos, strand, least(n, m) AS n FROM t, lim",
    "binomial_limit": f"{BASE}, {LIMIT} SELECT CAST(m AS BIGINT) AS max_duplicates FROM lim",
    "fragments_dedup": f'WITH {ITEMS} SELECT DISTINCT chrom, pos AS "left", pos + length AS "right", CAST(1 AS BIGINT) AS n FROM items WHERE treated',
    "fragment_counts_wrapped": f"WITH {ITEMS} SELECT chrom, CAST(sum(m) AS BIGINT) AS total, max(m) AS largest FROM (SELECT chrom, (((cnt * 40000 - 100000) % 65536) + 65536) % 65536 AS m FROM items WHERE treated) GROUP BY chrom",
    "intervals_normalised": """SELECT l_returnflag AS chrom, count(*) AS n, CAST(sum(abs(b - a)) AS BIGINT) AS bases, min(least(a, b)) AS first_left FROM (
        SELECT l_returnflag, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS b, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
    "union_replicates": f"WITH {ITEMS} SELECT chrom, CAST(sum(n) AS BIGINT) AS n, count(*) AS places FROM (SELECT chrom, pos, strand, count(*) AS n FROM items GROUP BY ALL) GROUP BY chrom",
    "mean_fragment": f"WITH {ITEMS} SELECT round(sum(length * cnt) / sum(cnt)::DOUBLE, 6) AS mean_length FROM items WHERE treated",
    "shifted_extension": f"{BASE} {_coverage(_extended('t', shift=-5))}",
    "pileup_se": f"{BASE} {_coverage(_extended('t'))}",
    "pileup_pe": f"WITH {ITEMS} {_coverage('SELECT DISTINCT chrom, pos AS s, pos + length AS e, 1 AS w FROM items')}",
    "pileup_weighted": f"WITH {ITEMS} {_coverage('SELECT chrom, pos AS s, pos + length AS e, cnt AS w FROM items')}",
    "pileup_clamped": f"""WITH {ITEMS}, ends AS (SELECT chrom, max(pos + length) - 30 AS last FROM items GROUP BY chrom)
        {_coverage('SELECT i.chrom, pos AS s, least(pos + length, last) AS e, cnt AS w FROM items i JOIN ends ON i.chrom = ends.chrom')}""",
    "pileup_signals": f"WITH {SIGNALS} {_coverage('SELECT chrom, pos AS s, pos + 30 AS e, 1 AS w FROM items')}",
    "stream_pileup": f"WITH {SIGNALS} {_compacted(_swept('SELECT chrom, pos, 1 AS value FROM items UNION ALL SELECT chrom, pos + 30, -1 FROM items', ['value']), ['value'])}",
    "stream_counts": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "track_align": f'{TRACKS} SELECT chrom, {RUN}, a::DOUBLE AS a, b::DOUBLE AS b FROM ({_aligned({"a": "ta", "b": "tb"})})',
    "track_compact": f"{TRACKS} " + _compacted('SELECT chrom, "start", "end", CAST(floor(value / 50.0) AS BIGINT) AS value FROM ta', ["value"]),
    "track_transform": f"{TRACKS} " + _compacted('SELECT chrom, "start", "end", least(value, 60)::DOUBLE AS value FROM ta', ["value"]),
    "track_combine": _method("(a + b)::DOUBLE / 2"),
    "poisson_score": f"{SCORED} SELECT chrom, {RUN}, round(p, 5) AS p FROM scored",
    "fold_enrichment": f"{SCORED} SELECT chrom, {RUN}, round(fe, 5) AS fe FROM scored",
    "qtable": f"{SCORED} SELECT chrom, {RUN}, round(q, 4) AS q FROM scored",
    "score_histogram": f'{SCORED} SELECT round(p, 1) AS score, CAST(sum("end" - "start") AS BIGINT) AS bases FROM scored GROUP BY 1',
    "peaks_narrow": f"{NARROW} SELECT chrom, {RUN}, summit, round(pileup, 4) AS pileup, round(p, 4) AS p, round(fe, 4) AS fe, round(q, 4) AS q, 'run_peak_' || row_number() OVER (ORDER BY chrom, \"start\") AS name FROM narrow",
    "summits": f'{NARROW} SELECT chrom, summit AS "start", summit + 1 AS "end", round(q, 4) AS q FROM narrow',
    "peaks_broad": f"{BROAD} SELECT chrom, {RUN}, round(pileup, 4) AS pileup, round(p, 4) AS p, round(fe, 4) AS fe FROM wide",
    "peaks_gapped": f"""{BLOCKS} SELECT chrom, a AS "start", b AS "end", count(*) AS block_count, string_agg((e - s)::VARCHAR, ',' ORDER BY s, e) AS block_sizes,
        string_agg((s - a)::VARCHAR, ',' ORDER BY s, e) AS block_starts FROM parts GROUP BY chrom, region, a, b""",
    "cutoff_curve": f"""{SCORED}, cuts AS (SELECT cutoff, scored.* FROM scored JOIN ({CURVE}) ON p > cutoff), found AS (SELECT cutoff, chrom, region, max("end") - min("start") AS length FROM ({_islands("SELECT * FROM cuts", GAP, "cutoff, chrom")})
        GROUP BY ALL HAVING max("end") - min("start") >= {LEAST}) SELECT cutoff, count(*) AS regions, CAST(sum(length) AS BIGINT) AS bases, round(avg(length), 6) AS mean_length FROM found GROUP BY cutoff""",
    "cutoff_scores": f"""{SCORED}, cuts AS (SELECT cutoff, scored.* FROM scored JOIN ({CURVE}) ON p > cutoff), least AS (SELECT cutoff, min(q) AS q FROM cuts GROUP BY cutoff),
        found AS (SELECT cutoff, chrom, region, max("end") - min("start") AS length FROM ({_islands("SELECT * FROM cuts", GAP, "cutoff, chrom")}) GROUP BY ALL HAVING max("end") - min("start") >= {LEAST})
        SELECT cutoff AS pscore, round(any_value(least.q), 4) AS qscore, count(*) AS npeaks, CAST(sum(length) AS BIGINT) AS lpeaks, round(avg(length), 6) AS avelpeak FROM found JOIN least USING (cutoff) GROUP BY cutoff""",
    "cutoff_analysis": f"""{SCORED}, cuts AS ({CUTS}), found AS (SELECT cutoff, chrom, region, max("end") - min("start") AS length FROM ({_islands("SELECT * FROM cuts", GAP, "cutoff, chrom")})
        GROUP BY ALL HAVING max("end") - min("start") >= {LEAST}) SELECT cutoff, count(*) AS regions, CAST(sum(length) AS BIGINT) AS bases, round(avg(length), 6) AS mean_length FROM found GROUP BY cutoff""",
    "bdgpeakcall": f"""{TRACKS}, isl AS ({_islands("SELECT * FROM ta WHERE value >= (SELECT floor(avg(value) * 1.1) FROM ta)", GAP)}),
        best AS (SELECT *, row_number() OVER (PARTITION BY chrom, region ORDER BY value DESC, "start") AS r FROM isl)
        SELECT chrom, min("start") AS "start", max("end") AS "end", max(CASE WHEN r = 1 THEN ("start" + "end") // 2 END) AS summit, max(value) AS score FROM best
        GROUP BY chrom, region HAVING max("end") - min("start") >= {LEAST}""",
    "bdgdiff": DIFF,
    "reads_in_regions": f'{NARROW} SELECT d.chrom, d."start", d."end", CAST(sum(n) AS BIGINT) AS reads FROM narrow d JOIN c ON d.chrom = c.chrom AND pos >= d."start" AND pos < d."end" GROUP BY ALL',
    "refinepeak": REFINED,
    "predictd": f"""{BASE} SELECT b.pos - a.pos AS "offset", CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM t a JOIN t b ON a.chrom = b.chrom AND a.strand = '+' AND b.strand = '-'
        AND b.pos > a.pos AND b.pos - a.pos <= 40 GROUP BY 1""",
    "summits_sg": f"""{SLOPES} SELECT chrom, a AS "start", b AS "end", name || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN chr(CAST(96 + row_number() OVER (PARTITION BY name ORDER BY summit) AS INTEGER)) ELSE '' END AS name,
        summit, height::DOUBLE AS height FROM whole""",
    "digested_bins": BINNED,
    "digestion": f"""WITH {ITEMS}, den AS (SELECT chrom, cnt, {", ".join(f"{x} AS d{i}" for i, x in enumerate(_DENSITY))} FROM items)
        SELECT chrom, {", ".join(f"round(sum(d{i} / (d0 + d1 + d2 + d3) * cnt), 3) AS w{i}" for i in range(4))} FROM den GROUP BY chrom""",
    "scale_small": f'{BASE}, {_enriched()} SELECT chrom, {RUN}, round(treat, 6) AS treat, round("lambda", 6) AS "lambda" FROM both_',
    "scale_large": f'{BASE}, {_enriched(scale="large")} SELECT chrom, {RUN}, round(treat, 6) AS treat, round("lambda", 6) AS "lambda" FROM both_',
    "lambda_nolambda": f'{BASE}, {_enriched(local=False)} SELECT chrom, {RUN}, round(treat, 6) AS treat, round("lambda", 6) AS "lambda" FROM both_',
    "lambda_nocontrol": f'{BASE}, {_enriched(control=False)} SELECT chrom, {RUN}, round(treat, 6) AS treat, round("lambda", 6) AS "lambda" FROM both_',
    "lambda_fragments": f'WITH {ITEMS}, {PAIRS}, {_enriched(pairs=True)} SELECT chrom, {RUN}, round(treat, 6) AS treat, round("lambda", 6) AS "lambda" FROM both_',
    "peaks_narrow_q": f"{_narrow('q', Q_CUTOFF)} SELECT chrom, {RUN}, summit, round(pileup, 4) AS pileup, round(p, 4) AS p, round(fe, 4) AS fe, round(q, 4) AS q, 'run_peak_' || row_number() OVER (ORDER BY chrom, \"start\") AS name FROM narrow",
    "peaks_broad_q": f"{_broad('q', Q_WEAK)} SELECT chrom, {RUN}, round(pileup, 4) AS pileup, round(p, 4) AS p, round(fe, 4) AS fe, round(q, 4) AS q, 'run_peak_' || row_number() OVER (ORDER BY chrom, \"start\") AS name FROM wide",
    "signal_per_million": f"{BASE}, {_enriched()}, million AS (SELECT chrom, {RUN}, treat * 1e6::DOUBLE / least(tn, cn) AS value FROM both_, tot) SELECT chrom, {RUN}, round(value, 4) AS value FROM ({_compacted('SELECT * FROM million', ['value'])})",
    **{f"bdgcmp_{m}": _method(x) for m, x in METHODS.items()},
    **{f"bdgcmp_{m}": f"{POISSON} SELECT chrom, {RUN}, round(value, 6) AS value FROM ({_compacted(f'SELECT chrom, {RUN}, {c} AS value FROM scored', ['value'])})" for m, c in (("ppois", "p"), ("qpois", "q"))},
}


def oracle_sql() -> dict[str, str]:
    """SQL by the name of the query."""
    return dict(ORACLE)
