"""URL filters: host and path rules, and a path-template tree for what no rule decides.

The tree is kept as tables, a row for each (host, template), never as an object.
Digit runs in a segment become typed wildcards.  Level by level from a host's
root, a node with many children of which none prevails has them generalised into
one wildcard; then siblings whose labelled shares do not differ statistically
are merged into one node with what lies below them: its totals are theirs alone,
and each labelled page counts once.

Labels are what the rules decide, and the seed words in a host's name.  A
template's purity is the labelled share of blocked pages, smoothed towards what
its neighbours say: the nearest node above it on its host that has other labelled
pages, and the same template on the nearest parent domain that has (all hosts
together at last).  A neighbour says its own share, in which its pages without a
label count at the prior, so a group of which little is known says little; it
weighs as many pages as it has, ``REACH`` at most, and the prior ``STRENGTH``.  A template is rejected where its
purity reaches ``REJECT``; without any evidence it keeps the prior.

Everything is aggregated to distinct (host, template) rows before any shuffle by
host, so a host with a third of all pages is as many rows as it has templates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, stored

#: (verdict, rule) pairs; a rule is a host and a path, and holds for subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words that mark a host by its name.
SEEDS = ("adult", "bet", "bets", "betting", "casino", "escort", "pill", "pills", "porn", "sex", "spam", "viagra", "xxx")
#: Children from which a node's segments may become a wildcard, and the share that spares it.
FAN, PREVAILS = 16, 0.5
#: Smoothing of a purity: the prior, how many labelled pages it weighs, and how many a neighbour weighs at most.
PRIOR, STRENGTH, REACH, REJECT = 0.2, 2.0, 8.0, 0.5
#: Two-sided 5 % point of the normal distribution.
ALIKE = 1.96
#: Parts that the rows under one template are dealt to where they meet its evidence over all hosts.
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decides)).otherwise(verdict)
    return rule, verdict


def _typed(segment: Column) -> Column:
    """A segment with its variable parts typed: long hexadecimal words, and digit runs."""
    plain = F.regexp_replace(segment, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{x}")
    return F.regexp_replace(plain, r"[0-9]+", "{n}")


#: Pages of a group, those with a label, and those labelled as blocked.
COUNTS = ("n", "labelled", "pos")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys are equal, nulls included."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys], how).drop(*[f"_r_{c}" for c in keys])


def _far(p: Column, n: Column, q: Column, m: Column) -> Column:
    """Whether the shares p of n and q of m differ by the test of two proportions."""
    whole = (p + q) / (n + m)
    spread = F.sqrt(F.greatest(whole * (1 - whole), F.lit(0.0)) * (1 / n + 1 / m))
    return F.abs(p / n - q / m) > ALIKE * spread + 1e-12


def _merged(rows: DataFrame, node: Sequence[str], child: str) -> DataFrame:
    """``child`` becomes '~' and a number for siblings whose labelled shares are alike; no typed segment has digits.

    Children with labelled pages are ordered by their share and cut where
    neighbours differ by the test; a stretch of two or more is merged unless its
    ends differ by the test.  Children without labelled pages stay as they are.
    """
    each = rows.where(F.col(child).isNotNull()).groupBy(*node, child).agg(F.sum("pos").alias("p"), F.sum("labelled").alias("m")).where("m > 0")
    kinds = each.groupBy(*node, "p", "m").agg(F.count("*").alias("same"))
    order = Window.partitionBy(*node).orderBy(F.col("p") / F.col("m"), "m")
    cut = F.when(F.lag("m").over(order).isNull() | _far(F.col("p"), F.col("m"), F.lag("p").over(order), F.lag("m").over(order)), 1).otherwise(0)
    kinds = kinds.withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    share = F.col("p") / F.col("m")
    ends = [f(F.struct(share.alias("s"), (F.col("m") * way).alias("w"), "p", "m")).alias(x) for f, way, x in ((F.min, -1, "low"), (F.max, 1, "high"))]
    stretches = kinds.groupBy(*node, "stretch").agg(F.sum("same").alias("size"), *ends)
    alike = stretches.where((F.col("size") > 1) & ~_far(F.col("low.p"), F.col("low.m"), F.col("high.p"), F.col("high.m"))).select(*node, "stretch", F.concat(F.lit("~"), "stretch").alias("to"))
    to = _joined(each, _joined(kinds, alike, [*node, "stretch"], "inner").select(*node, "p", "m", "to"), [*node, "p", "m"], "inner").select(*node, child, "to")
    return _joined(rows, to, [*node, child]).withColumn(child, F.coalesce("to", child)).drop("to")


def branching(paths: DataFrame, fan: int = FAN) -> int:
    """The deepest level at which a node of over ``fan`` pages has two children or more, of distinct (host, segments, n); 1 at least.

    The end of a path is a child as well.
    """
    size = F.size("segments")
    step = F.explode(F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.struct(i.alias("level"), F.xxhash64(F.slice("segments", F.lit(1), i - 1)).alias("node"), F.when(i <= size, F.xxhash64(F.get("segments", i - 1))).otherwise(F.lit(0)).alias("child"))))
    nodes = paths.select("host", "n", step.alias("x")).groupBy("host", "x.level", "x.node").agg(F.sum("n").alias("n"), F.min("x.child").alias("low"), F.max("x.child").alias("high"))
    return nodes.where((F.col("n") > fan) & (F.col("low") != F.col("high"))).agg(F.max("level")).first()[0] or 1


def templates(rows: DataFrame, depth: int, fan: int = FAN) -> DataFrame:
    """Adds g1..g<depth>, the template of (host, s1..s<depth>, rest, n, pos, labelled) rows, and t1..t<depth>, its place in the merged tree."""
    done = rows
    for level in range(1, depth + 1):
        node = ["host", *[f"t{i}" for i in range(1, level)]]
        child = done.groupBy(*node, f"s{level}").agg(F.sum("n").alias("n"))
        wide = child.groupBy(*node).agg(F.count(f"s{level}").alias("children"), F.max("n").alias("top"), F.sum("n").alias("all"))
        wide = wide.where((F.col("children") > fan) & (F.col("top") < PREVAILS * F.col("all"))).select(*node, F.lit(True).alias("wild"))
        general = F.when(F.col("wild") & F.col(f"s{level}").isNotNull(), F.lit("*")).otherwise(F.col(f"s{level}"))
        named = _joined(done, wide, node).withColumn(f"g{level}", general).drop("wild")
        named = stored(named.withColumn(f"t{level}", F.col(f"g{level}")), "url-level")
        done = stored(_merged(named, node, f"t{level}"), "url-level")
    return done


def parent_domains(host: Column) -> tuple[Column, Column]:
    """The host without its first label (two stay), and its last two labels."""
    short = F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    return short, F.substring_index(short, ".", -2)


def _totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def nearest(branches: DataFrame, chain: Sequence[Sequence[str]], name: str, salts: int = 1) -> DataFrame:
    """Adds <name>_n, <name>_labelled, <name>_pos to rows (keys, n, labelled, pos): the other pages of the nearest wider group.

    ``chain`` lists the keys of ever wider groups.  A group counts where it has
    labelled pages outside the one below; where none has, all three are zero.
    The widest group's totals are repeated for each of ``salts`` parts of what
    joins them.
    """
    tables = [branches]
    for keys in chain:
        tables.append(_totals(tables[-1], keys))
    known = tables[-1].select("*", *[F.lit(0).cast("long").alias(f"{name}_{c}") for c in COUNTS])
    for k in reversed(range(len(chain))):
        keys, below = list(chain[k]), tables[k]
        wider = known.select(*keys, *[F.col(c).alias(f"_{c}") for c in COUNTS], *[F.col(f"{name}_{c}").alias(f"_far_{c}") for c in COUNTS])
        if k == len(chain) - 1 and salts > 1:
            wider = wider.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            spread = below.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in below.columns if c not in keys]), F.lit(salts)).cast("int"))
            both = _joined(spread, wider, [*keys, "_salt"])
        else:
            both = _joined(below, wider, keys)
        others = F.col("_labelled") > F.col("labelled")
        known = both.select(*below.columns, *[F.when(others, F.col(f"_{c}") - F.col(c)).otherwise(F.col(f"_far_{c}")).alias(f"{name}_{c}") for c in COUNTS])
    return known


def purity(general: DataFrame, depth: int) -> DataFrame:
    """(host, g1.., rest, purity) for each template of (host, g1.., t1.., rest, n, labelled, pos) rows."""
    g, t = ([f"{x}{i}" for i in range(1, depth + 1)] for x in "gt")
    rows = stored(_totals(general, ["host", *g, *t, "rest"]), "url-branches")
    short, two = parent_domains(F.col("host"))
    ups = nearest(_totals(rows, ["host", *t, "rest"]), [["host", *t[:k]] for k in range(depth, -1, -1)], "up")
    sides = nearest(rows.select("host", short.alias("d1"), two.alias("d2"), *g, "rest", *COUNTS), [["d1", "d2", *g, "rest"], ["d2", *g, "rest"], [*g, "rest"]], "side", SALTS)
    found = _joined(rows.select("host", *g, *t, "rest"), ups, ["host", *t, "rest"])
    found = _joined(found, sides.select("host", *g, "rest", *[f"side_{c}" for c in COUNTS]), ["host", *g, "rest"])
    top, bottom = F.col("pos") + PRIOR * STRENGTH, F.col("labelled") + STRENGTH
    for name in ("up", "side"):
        n, labelled, pos = (F.col(f"{name}_{c}").cast("double") for c in COUNTS)
        weight = F.least(n, F.lit(REACH))
        top, bottom = top + F.when(n > 0, weight * (pos + PRIOR * (n - labelled)) / n).otherwise(0.0), bottom + weight
    return found.select("host", *g, "rest", (top / bottom).alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS, depth: int | None = None, fan: int = FAN) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of ``pages`` (page_id, url, and any others).

    ``verdict`` is the rule's where one fits, else 'block' for a rejected
    template and 'allow' for any other.  A null url, or one without ``://``, has
    empty host and path and is judged like any other page of that host.
    Repeated rows each get a row and count each as a page; an empty table gives
    no rows.  Levels go on as deep as any node of over ``fan`` pages branches
    (``branching``), or to ``depth`` where one is given; the segments below that are one, ``**``.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = F.split(F.col("path"), "/")
    seeded = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(s) for s in seeds])) if seeds else F.lit(False)
    label = F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("long")).when(seeded, F.lit(1).cast("long"))
    if depth is None:
        typed = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _typed)
        depth = branching(base.select("host", typed.alias("segments")).groupBy("host", "segments").agg(F.count("*").alias("n")), fan)
    names = [f"s{i}" for i in range(1, depth + 1)]
    segments = [F.when(F.size(parts) > i, _typed(F.get(parts, F.lit(i)))).alias(f"s{i}") for i in range(1, depth + 1)]
    rest = F.when(F.size(parts) > depth + 1, F.lit("**")).alias("rest")
    rows = base.select("*", rule.alias("rule"), verdict.alias("rule_verdict")).select("*", *segments, rest, label.alias("label"))
    keys = ["host", *names, "rest"]
    counted = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos"), F.count("label").alias("labelled")), "url-templates")
    general = templates(counted, depth, fan)
    tree = ["host", *[f"g{i}" for i in range(1, depth + 1)], "rest"]
    rated = purity(general, depth)
    text = F.concat(F.lit(""), *[F.when(F.col(g).isNotNull(), F.concat(F.lit("/"), F.col(g))).otherwise("") for g in tree[1:-1]], F.when(F.col("rest").isNotNull(), F.lit("/**")).otherwise(""))
    by_key = stored(_joined(general, rated, tree).select(*keys, text.alias("template"), "purity"), "url-purities")
    out = _joined(rows, by_key, keys)
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "template", "purity")
