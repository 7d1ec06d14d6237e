"""URL filter: a tree of path templates for each host, after curated rules.

Rules. A rule `host/path` fits its host and all subdomains where the url's path
starts with the rule's; the longest decides.

Tree. Urls that a rule decides are the labelled ones. Paths are first made
plain: numbers, hex strings and dates become typed places. Then the tree is
walked from the root, a branching of all hosts at a time, on counts of paths
rather than on urls. What all paths of a place have in common is passed in one
step, and a place with one path left is done, so a long path alone costs
nothing. At a branching:

* a segment becomes a wildcard where its parent has more than MAX_CHILDREN
  children and it holds less than MIN_SHARE of the parent's urls;
* siblings are kin if the same segment follows them most often; they merge if what
  follows them is distributed as in their kin together (total variation up to
  MAX_DISTANCE) and their shares of bad labels agree: siblings that are as bad
  as all together, those that are significantly (Z standard deviations) less bad
  and those more bad merge apart from each other, each only where it agrees with
  its set; branches without labels say nothing against the first of these and
  join it, so what looks like labelled kin shares its labels.

This goes on as long as anything branches; a round costs the places that still
do, whatever their depth.

Purity. A place's purity is the share of allowed labels below it, smoothed by
PRIOR labels as pure as its parent; that of a host by its parent domains of two
labels or more, one after another, and theirs by one half. So a
template without labels is as pure as what is around it, and one half where
there are no labels in the whole domain. Templates below MIN_PURITY are rejected.

All of it is aggregation and equi-joins, with map-side combination. Tables are
written before they are joined, so each join stands on two scans and adaptive
execution can split a hot host or place.

Defined cases: a null url, or one without `://`, has empty host and path and is
judged by the template of these; empty segments count as segments; repeated
rows are judged alike; an empty table gives an empty result; other columns
aren't read. Of rules of equal length that fit one url that with
the longer host decides, then the first in order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

MAX_CHILDREN, MIN_SHARE = 32, 1 / 32
MAX_DISTANCE, Z = 0.25, 1.96
PRIOR, MIN_PURITY = 4.0, 0.25
#: Rounds of the tree after which its finished templates are written together.
ROUNDS = 16
#: Labels, half of them bad, that are added to a rate before rates are compared.
EVEN = 2.0
WILD = "/*"
#: Rules written into one expression at most; more are joined.
INLINE_RULES = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_path(path: Column) -> Column:
    """The path with typed places for dates, numbers and hex strings that fill a segment up to its extension."""
    for pattern, place in ((r"(?<=/)\d{4}-\d{2}-\d{2}(?=[./]|$)", "{date}"), (r"(?<=/)\d+(?=[./]|$)", "{num}"), (r"(?<=/)(?=[a-f]*\d)[0-9a-f]{8,}(?=[./]|$)", "{hex}")):
        path = F.regexp_replace(path, pattern, place)
    return path


def apply_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls with the columns rule and rule_verdict; rules: (rule, allow or block)."""
    longest = sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0]), r[0]))
    if len(longest) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for r, v in reversed(longest):
            host, _, path = r.partition("/")
            fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
            rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
        return urls.withColumns({"rule": rule, "rule_verdict": verdict})
    known = urls.sparkSession.createDataFrame([(*r.partition("/")[::2], r, v) for r, v in longest], "rule_host string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    places = urls.select("host", "path").distinct()
    ends = places.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    found = ends.join(known, "rule_host").where(F.expr("startswith(path, concat('/', rule_path))"))
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("size"), (-F.length("rule_host")).alias("host"), "rule", "rule_verdict")).alias("r")).select("host", "path", "r.rule", "r.rule_verdict")
    return urls.join(best, ["host", "path"], "left")


def _rate(bad: Column, labelled: Column) -> Column:
    return (bad + EVEN / 2) / (labelled + EVEN)


def _test(a: str, b: str) -> tuple[Column, Column]:
    """How much a set's rate of bad labels differs from that of the set around it, and how much of that may be chance."""
    of = lambda x: F.col(f"{x}_good") + F.col(f"{x}_bad")
    pooled = _rate(F.col(f"{b}_bad"), of(b))
    differs = F.coalesce(F.try_divide(F.col(f"{a}_bad"), of(a)) - pooled, F.lit(0.0))
    return differs, Z * F.sqrt(pooled * (1 - pooled) * (F.coalesce(F.try_divide(F.lit(1), of(a)), F.lit(1)) + 1 / (of(b) + EVEN)))


def _smoothed(good: Column, bad: Column, around: Column) -> Column:
    return (good + PRIOR * around) / (good + bad + PRIOR)


def host_purity(rows: DataFrame) -> DataFrame:
    """(host, purity) from rows (host, good, bad)."""
    hosts = stored(rows.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    labels = F.size(F.split("host", r"\."))
    chain = hosts.where(labels > 2).withColumn("k", F.explode(F.sequence(F.lit(2), labels - 1))).withColumn("domain", F.expr("substring_index(host, '.', -k)"))
    domains = stored(chain.groupBy("domain").agg(F.sum("good").alias("d_good"), F.sum("bad").alias("d_bad")))
    found = chain.join(domains, "domain").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", F.col("d_good").alias("good"), F.col("d_bad").alias("bad")))).alias("above"))  # as many as a host has labels
    own = F.array(F.struct(F.lit(1 << 30).alias("k"), "good", "bad"))
    start = F.struct(F.lit(0.5).alias("p"), F.lit(-1).cast("long").alias("good"), F.lit(-1).cast("long").alias("bad"))

    def step(s: Column, x: Column) -> Column:
        """The labels of a domain with a single host count once."""
        same = (s["good"] == x["good"]) & (s["bad"] == x["bad"])
        return F.struct(F.when(same, s["p"]).otherwise(_smoothed(x["good"], x["bad"], s["p"])).alias("p"), x["good"].alias("good"), x["bad"].alias("bad"))

    every = F.when(F.col("above").isNull(), own).otherwise(F.concat("above", own))
    return stored(hosts.join(stored(found), "host", "left").select("host", F.aggregate(every, start, step, lambda s: s["p"]).alias("purity")))


PLACE = ["host", "done"]


def _arrived(live: DataFrame) -> DataFrame:
    """The rows at their next branching, past all that the paths of a place have in common.

    Adds alone (one path is left), key (the segment here after a slash, or empty
    where a path ends) and next (what follows it in the same form; `-` after an end).
    """
    span = live.groupBy(*PLACE).agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    differs = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
    span = stored(span.select(*PLACE, (F.col("low") == F.col("high")).alias("alone"), F.when(differs == 0, F.size("low")).otherwise(differs - 1).cast("int").alias("c")))
    rows = live.join(span, PLACE)
    passed = F.concat("done", F.when(F.col("c") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("c")), "/"))).otherwise(""))
    rows = rows.withColumns({"done": passed, "rest": F.slice("rest", F.col("c") + 1, F.size("rest"))})
    at = lambda i: F.concat(F.lit("/"), F.get("rest", F.lit(i)))
    key, after = F.coalesce(at(0), F.lit("")), F.when(F.size("rest") == 0, "-").otherwise(F.coalesce(at(1), F.lit("")))
    return stored(rows.select("host", "plain", "done", "alone", key.alias("key"), after.alias("next"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), "n", "good", "bad", "purity"))


def _kinds(here: DataFrame) -> DataFrame:
    """(host, done, key, name, purity): what each branch is called, and its smoothed purity."""
    total = lambda prefix: [F.sum(f"{'own_' if prefix else ''}{c}").alias(f"{prefix or 'own_'}{c}") for c in ("n", "good", "bad")]
    counts = stored(here.groupBy(*PLACE, "key", "next").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")], F.any_value("purity").alias("purity")))
    own = stored(counts.groupBy(*PLACE, "key").agg(F.max(F.struct("n", "next"))["next"].alias("mode"), *total(""), F.any_value("purity").alias("purity")))
    kin = own.groupBy(*PLACE, "mode").agg(F.count("*").alias("branches"), *total("all_"))
    every = kin.groupBy(*PLACE).agg(F.sum("branches").alias("children"), F.sum("all_n").alias("parent_n"))
    own = stored(own.join(stored(kin.join(every, PLACE)), [*PLACE, "mode"]))
    after = stored(counts.select(*PLACE, "key", "next", "n").join(own.select(*PLACE, "key", "mode", "own_n", "all_n"), [*PLACE, "key"]))
    pool = stored(after.groupBy(*PLACE, "mode", "next").agg(F.sum("n").alias("next_n")))
    share, common = F.col("n") / F.col("own_n"), F.col("next_n") / F.col("all_n")
    distance = stored(after.join(pool, [*PLACE, "mode", "next"]).groupBy(*PLACE, "key").agg((0.5 * (1 + F.sum(F.abs(share - common) - common))).alias("distance")))
    one, spread = _test("own", "all")
    side = F.when(F.abs(one) <= spread, "same").when(one < 0, "low").otherwise("high")
    wild = (F.col("children") > MAX_CHILDREN) & (F.col("own_n") < MIN_SHARE * F.col("parent_n")) & (F.col("key") != "")
    own = stored(own.join(distance, [*PLACE, "key"]).withColumns({"wild": wild, "side": F.when((F.col("distance") <= MAX_DISTANCE) & ~wild & (F.col("key") != ""), side)}))
    sides = stored(own.where("side is not null").groupBy(*PLACE, "mode", "side").agg(F.count("*").alias("alike"), *[F.sum(f"own_{c}").alias(f"side_{c}") for c in ("good", "bad")]))
    own = own.join(sides, [*PLACE, "mode", "side"], "left")
    one, spread = _test("own", "side")
    alike = F.coalesce((F.col("alike") > 1) & (F.abs(one) <= spread), F.lit(False))
    merged = F.concat(F.lit("/{"), "side", F.lit("~"), F.substring("mode", 2, 1 << 30), F.lit("}"))
    named = stored(own.select(*PLACE, "key", F.when(F.col("wild"), WILD).when(alike, merged).otherwise(F.col("key")).alias("name"), "own_good", "own_bad", "purity"))
    pure = named.groupBy(*PLACE, "name").agg(_smoothed(F.sum("own_good"), F.sum("own_bad"), F.any_value("purity")).alias("purity"))
    return stored(named.drop("purity").join(stored(pure), [*PLACE, "name"]).select(*PLACE, "key", "name", "purity"))


def learn_templates(urls: DataFrame) -> DataFrame:
    """(host, plain, template, purity) for each host and plain path of urls (host, plain, good, bad)."""
    rows = stored(urls.groupBy("host", "plain").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    live = stored(rows.join(host_purity(rows), "host").select("host", "plain", F.lit("").alias("done"), F.split("plain", "/").alias("rest"), "n", "good", "bad", "purity"))
    out = lambda df, done: df.select("host", "plain", F.substring(done, 2, 1 << 30).alias("template"), "purity")
    finished = []
    while not live.isEmpty():
        here = _arrived(live)
        branching = here.where("NOT alone")
        moved = branching.drop("purity").join(_kinds(branching), [*PLACE, "key"])
        # The rest of a path that is left alone is passed already.
        finished += [out(here.where("alone"), F.col("done")), out(moved.where("key = ''"), F.col("done"))]
        live = stored(moved.where("key != ''").select("host", "plain", F.concat("done", "name").alias("done"), "rest", "n", "good", "bad", "purity"))
        if len(finished) > 2 * ROUNDS:
            finished = [stored(_union(finished))]
    return stored(_union(finished or [out(live, F.col("done"))]))


def _union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other)
    return every


def judge(df: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for each row of df."""
    address = F.col(url).cast("string")
    urls = df.select(F.col(key).alias("key"), host_of(address).alias("host"), path_of(address).alias("path"))
    urls = apply_rules(urls, rules).withColumn("plain", plain_path(F.col("path")))
    says = lambda v: F.coalesce(F.col("rule_verdict") == v, F.lit(False)).cast("long")
    templates = learn_templates(urls.withColumns({"good": says("allow"), "bad": says("block")}))
    out = urls.join(templates.select("host", "plain", "template", "purity"), ["host", "plain"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
