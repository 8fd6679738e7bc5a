"""Enrichment as set operations: registry rules in one scan, indicators, verdict joins, host identity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.functions.ids import quoted
from sedgewire.functions.validators import is_domain, is_external_ip, is_hash

# Fixed values: (part of the key path, value name, reason) of the rules that flag any value.
REGISTRY_RULES = (
    (r"Image File Execution Options", "Debugger", "IFEO debugger: "),
    (r"SilentProcessExit", "MonitorProcess", "SilentProcessExit monitor: "),
    (r"CurrentVersion\Windows", "AppInit_DLLs", "AppInit_DLLs: "),
    (r"Winlogon", "mpnotify", "Winlogon mpnotify: "),
    (r"Print\Monitors", "Driver", "Print Monitor DLL: "),
    (r"Command Processor", "AutoRun", "cmd.exe AutoRun: "),
    (r"CurrentVersion\Windows", "Load", "Explorer Load: "),
    (r"Terminal Services", "InitialProgram", "TS InitialProgram: "),
)
# The packages that Windows itself lists under Control\Lsa.
LSA_DEFAULTS = ("kerberos", "msv1_0", "schannel", "wdigest", "tspkg", "pku2u", "cloudap", "negoexts", "scecli", "rassfm")
LSA_VALUES = ("Authentication Packages", "Security Packages", "Notification Packages")
# Fields that hold indicators.
IOC_FIELDS = {"ip": ("source.ip", "destination.ip", "ForeignAddr"), "hash": ("SHA1", "SHA256", "MD5"), "domain": ("query", "dns.query", "url.domain", "dns.rrname")}


def registry_reason(key: Column, name: Column, data: Column) -> Column:
    """Why a registry value is suspicious, or null. The rules' value names differ, so at most one applies."""
    out = F.lit(None).cast("string")
    for path, value, reason in REGISTRY_RULES:
        out = F.when(key.contains(path) & (name == value), F.concat(F.lit(reason), data)).otherwise(out)
    odd = F.filter(F.split(F.lower(F.trim(data)), r"[\n| ]+"), lambda x: (x != "") & ~x.isin(*LSA_DEFAULTS))
    for value in LSA_VALUES:
        out = F.when(key.contains(r"Control\Lsa") & (name == value) & (F.size(odd) > 0), F.concat(F.lit(f"Non-default {value}: "), F.array_join(odd, ", "))).otherwise(out)
    plain = F.lower(F.trim(data))
    shell = (plain != "") & (F.element_at(F.split(plain, r"\\"), -1) != "explorer.exe")
    out = F.when(key.contains("Winlogon") & (name == "Shell") & shell, F.concat(F.lit("Winlogon Shell: "), data)).otherwise(out)
    init = F.regexp_replace(plain, ",$", "")
    out = F.when(key.contains("Winlogon") & (name == "Userinit") & (plain != "") & ~init.endswith("userinit.exe"), F.concat(F.lit("Winlogon Userinit: "), data)).otherwise(out)
    out = F.when(key.contains("Session Manager") & (name == "BootExecute") & (F.trim(data) != "autocheck autochk *"), F.concat(F.lit("BootExecute: "), F.trim(data))).otherwise(out)
    saver = key.contains(r"Control Panel\Desktop") & (name == "SCRNSAVE.EXE") & (plain != "")
    outside = plain.contains("\\") & ~plain.contains("system32") & ~plain.contains("winsxs")
    out = F.when(saver & ~plain.endswith(".scr"), F.concat(F.lit("Screensaver non-.scr: "), data)).when(saver & outside, F.concat(F.lit("Screensaver outside System32: "), data)).otherwise(out)
    return F.when(data.isNotNull(), out)


def registry_rules(df: DataFrame) -> DataFrame:
    """Stamps the rows (KeyPath, ValueName, ValueData) that a persistence rule hits; others keep nulls, not marked checked."""
    reason = registry_reason(F.col("KeyPath"), F.col("ValueName"), F.col("ValueData"))
    out = df.withColumn("triage.reason", reason)
    hit = F.col("`triage.reason`").isNotNull()
    return out.withColumn("triage.verdict", F.when(hit, F.lit("SUSPICIOUS"))).withColumn("triage.checked", F.when(hit, F.lit(True)))


def indicators(df: DataFrame, fields: dict[str, tuple[str, ...]] | None = None, force: bool = False) -> DataFrame:
    """(type, field, value, valid): the distinct indicator values of rows not checked yet, exact and uncapped."""
    if not force and "threat_intel.checked" in df.columns:
        df = df.where(quoted("threat_intel.checked").isNull())
    found = [F.struct(F.lit(t).alias("type"), F.lit(f).alias("field"), quoted(f).cast("string").alias("value")) for t, names in (fields or IOC_FIELDS).items() for f in names if f in df.columns]
    rows = df.select(F.explode(F.array(*found)).alias("i")).select("i.*").where("value is not null").distinct()
    good = F.when(F.col("type") == "ip", is_external_ip(F.col("value"))).when(F.col("type") == "hash", is_hash(F.col("value"))).otherwise(is_domain(F.col("value")))
    return rows.withColumn("valid", good)


def intel_verdict(found: Column, confidence: Column) -> Column:
    return F.when(found & (confidence >= 80), F.lit("MALICIOUS")).when(found, F.lit("SUSPICIOUS"))


def stamp(df: DataFrame, verdicts: DataFrame, name: str, prefix: str = "triage", columns: tuple[str, ...] = ("verdict", "reason", "confidence")) -> DataFrame:
    """Left join of one verdict per value. Verdicts of several rows for a value: the worst, then the most confident.
    The optimiser broadcasts the verdicts where their size allows it."""
    one = best_verdicts(verdicts, ["value"], columns)
    have = [c for c in columns if c in verdicts.columns]
    right = one.select(F.col("value").alias("on_"), *(F.col(c).alias(f"{prefix}.{c}") for c in have), F.lit(True).alias(f"{prefix}.checked"))
    return df.withColumn("key_", spread(quoted(name), df)).join(right, F.col("key_") == F.col("on_"), "left").drop("on_", "key_")


def best_verdicts(verdicts: DataFrame, by: list[str], columns: tuple[str, ...]) -> DataFrame:
    """One verdict for each key: the worst, then the most confident. Partial maxima, so a hot key is no burden."""
    rank = F.when(F.col("verdict") == "MALICIOUS", 3).when(F.col("verdict") == "SUSPICIOUS", 2).when(F.col("verdict").isNotNull(), 1).otherwise(0)
    order = [rank, *(F.col(c) for c in columns if c in verdicts.columns and c != "verdict")]
    row = F.max_by(F.struct(*verdicts.columns), F.struct(*order))
    return verdicts.groupBy(*by).agg(row.alias("row_")).select("row_.*")


def spread(key: Column, df: DataFrame) -> Column:
    """A key to join by, in whose place rows without one have many that fit nothing; so they do not meet in one task."""
    plain = [quoted(f.name) for f in df.schema if f.dataType.simpleString() in ("string", "bigint", "int", "timestamp", "timestamp_ntz", "double")]
    return F.coalesce(key.cast("string"), F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*plain) if plain else F.lit(0), F.lit(4096)).cast("string")))


def stamp_any(df: DataFrame, verdicts: DataFrame, fields: dict[str, tuple[str, ...]] | None = None, prefix: str = "threat_intel", columns: tuple[str, ...] = ("verdict", "confidence")) -> DataFrame:
    """Stamps rows of which any field of a verdict's type holds its value (type, value, verdict, ...). Of several the
    worst counts, then the most confident. What rows had before stays where none fits."""
    have = [c for c in columns if c in verdicts.columns]
    one = best_verdicts(verdicts.where("value is not null"), ["type", "value"], columns)
    rank = F.when(F.col("verdict") == "MALICIOUS", 3).when(F.col("verdict") == "SUSPICIOUS", 2).when(F.col("verdict").isNotNull(), 1).otherwise(0)
    out, found = df, []
    for t, names in (fields or IOC_FIELDS).items():
        right = one.where(F.col("type") == t).select(F.col("value").alias("on_"), F.struct(rank.alias("rank"), *(F.col(c) for c in have if c != "verdict"), "verdict", F.lit(t).alias("type"), F.col("value")).alias("v_"))
        for name in names:
            if name in df.columns:
                k = f"v{len(found)}_"
                out = out.withColumn("key_", spread(quoted(name), df)).join(right.withColumnsRenamed({"on_": f"on{k}", "v_": k}), F.col("key_") == F.col(f"on{k}"), "left").drop("key_", f"on{k}")
                found.append(F.col(k))
    worst = F.array_max(F.array_compact(F.array(*found))) if found else None
    put = {f"{prefix}.{c}": worst[c] for c in have} | {f"{prefix}.ioc_type": worst["type"], f"{prefix}.checked": F.lit(True)} if found else {}
    put = {k: F.when(worst.isNotNull(), v).otherwise(quoted(k)) if k in df.columns else F.when(worst.isNotNull(), v) for k, v in put.items()}
    return out.select(*(quoted(c) for c in df.columns if c not in put), *(v.alias(k) for k, v in put.items()))


def normal_host(x: Column) -> Column:
    """Trimmed, lower case, without one trailing dot."""
    return F.regexp_replace(F.lower(F.trim(x)), r"\.$", "")


def resolve_hosts(df: DataFrame, aliases: DataFrame, name: str = "host.name") -> DataFrame:
    """host.id: the canonical name of the alias (alias, canonical), or the name as it is."""
    known = aliases.select(normal_host(F.col("alias")).alias("alias_"), "canonical").dropDuplicates(["alias_"])
    out = df.drop("host.id").join(known, normal_host(quoted(name)) == F.col("alias_"), "left")
    return out.withColumn("host.id", F.coalesce("canonical", quoted(name))).drop("alias_", "canonical")


# What triage tools put after a host's name.
TRIAGE_SUFFIXES = ("-triage", "_triage")


def bare_host(x: Column, domains: list[str] | tuple[str, ...] = ()) -> Column:
    """A host's name without a triage suffix and without one of the domains, the longest that fits."""
    out = F.regexp_replace(normal_host(x), f"(?:{'|'.join(TRIAGE_SUFFIXES)})$", "")
    ends = "|".join(re.escape(d.lower().lstrip(".")) for d in domains if d.strip("."))
    return F.regexp_replace(out, rf"\.(?:{ends})$", "") if ends else out


def _dealt(df: DataFrame, name: str) -> DataFrame:
    """df over as many tasks as there are cores or shuffle partitions: few rows, but much work for each. By a hash of the
    name, as Spark leaves out a repartition by what rows were grouped by, and makes few tasks of few bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(name))


def _grams(df: DataFrame, name: str) -> DataFrame:
    """df (name, length) with its grams: pairs of neighbouring characters, ends marked, each with its number among equals."""
    text = F.concat(F.lit("\x01"), F.col(name), F.lit("\x02"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda k: F.substring(text, k, F.lit(2)))
    numbered = _dealt(df, name).withColumn("pairs_", pairs)
    each = F.transform("pairs_", lambda g, k: F.struct(g.alias("gram"), F.size(F.filter(F.slice("pairs_", F.lit(1), k + 1), lambda x: x == g)).alias("number"), k.alias("at")))
    return numbered.select(*df.columns, F.explode(each).alias("g")).select(*df.columns, "g.*")


def _most_edits(length: Column, least: float) -> Column:
    return F.floor((1 - least) * length + 1e-9).cast("int")


def _shuffled(one: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joined without a broadcast: Spark guesses the size of exploded rows by that of the rows they come from."""
    return one.join(other.hint("merge"), on, how)


def _ways(edits: int) -> list[tuple[int, int, int]]:
    """How many characters are left out of the name, out of the canonical, and replaced, so that they are so many edits apart."""
    return [(a, b, edits - a - b) for a in range(edits + 1) for b in range(edits + 1 - a)]


def _left(df: DataFrame, name: str, edits: int, least: float, longest: int, lengths: DataFrame, side: int) -> DataFrame:
    """df with what is left of a column, one or two edits taken out in any of _ways: `way`, the text `left_`, and the places
    `at` where it had characters that may be replaced. side: 0 for names, 1 for canonicals; lengths: those of the other side."""
    shortest = min((n for n in range(1, longest + 1) if int((1 - least) * n + 1e-9) >= edits), default=longest + 1)
    cut = lambda x, k: f"concat(substring({x}, 1, {k} - 1), substring({x}, {k} + 1))"
    last_alike = lambda x, k: f"substring({x}, {k}, 1) <> substring({x}, {k} + 1, 1)"  # noqa: E731  # of equal neighbours one is enough
    ways = []
    for k, way in enumerate(_ways(edits)):
        other = f"length({name}) + {way[1 - side] - way[side]}"
        fits = f"greatest(length({name}), {other}) between {shortest} and {longest} and array_contains(lengths_, {other})"
        ways.append(f"case when {fits} then struct({k} as way, {way[side]} as out, {way[2]} as open) end")
    rows = _dealt(df, name).crossJoin(F.broadcast(lengths)).selectExpr(*df.columns, f"inline(array_compact(array({', '.join(ways)})))")
    rows = rows.selectExpr("*", f"explode(if(out + open = 0, array(0), sequence(1, length({name})))) as i")
    rows = rows.where(f"i = 0 or out = 0 or {last_alike(name, 'i')}").selectExpr("*", f"if(i = 0, {name}, {cut(name, 'i')}) as one")
    rows = rows.selectExpr("*", "case when out = 2 then greatest(i - 1, 1) when open = 2 then i else 1 end as from_j")
    rows = rows.selectExpr("*", "explode(case when out + open < 2 then array(0) when from_j <= length(one) then sequence(from_j, length(one)) else cast(array() as array<int>) end) as j")
    at = "case when open = 0 then 0 when open = 2 then i * 64 + j when out = 0 then i else j end as at"
    return rows.where(f"j = 0 or out < 2 or {last_alike('one', 'j')}").selectExpr(*df.columns, "way", at, f"if(j = 0, one, {cut('one', 'j')}) as left_")


def _by_edits(asked: DataFrame, known: DataFrame, edits: int, least: float, longest: int, of_names: DataFrame, of_hosts: DataFrame) -> DataFrame:
    """(n_, best): the closest of known (h_, canonical) by at most so many edits, 1 or 2, for names of at most `longest`
    characters. Texts that meet with a way's characters left out are that close, so of the canonicals that leave a text the
    first one is enough: no pairs are made, and work grows with the names alone. A score may be too low where fewer edits do.
    of_names, of_hosts: the lengths that there are."""
    of_known = _left(known, "h_", edits, least, longest, of_names, 1).groupBy("way", "at", "left_").agg(F.min("canonical").alias("canonical"))
    of_asked = _left(asked, "n_", edits, least, longest, of_hosts, 0)
    both = _shuffled(of_asked, of_known, ["way", "at", "left_"])
    more = F.element_at(F.array(*(F.lit(max(b - a, 0)) for a, b, _ in _ways(edits))), F.col("way") + 1)
    both = both.withColumn("score", 1 - edits / (F.length("n_") + more)).where(F.col("score") >= least - 1e-12)
    return both.groupBy("n_").agg(F.min(F.struct((-F.col("score")).alias("s"), "canonical")).alias("best"))


def _by_grams(asked: DataFrame, known: DataFrame, least: float, longest: int) -> DataFrame:
    """Pairs of names of which one has more than `longest` characters: two names within k edits share one of the 2k + 1
    grams of each that are rarest among the canonicals, at places at most k apart."""
    lengths = F.sequence(F.ceil(F.length("n_") * least).cast("int"), F.floor(F.length("n_") / least).cast("int"))
    known = known.withColumn("length", F.length("h_"))
    #: Lengths of host names are few, so what has no partner of a fitting length goes first.
    asked = asked.withColumn("length", F.explode(F.filter(lengths, lambda x: F.greatest(x, F.length("n_")) > longest)))
    asked = asked.join(F.broadcast(known.select("length").distinct()), "length")
    of_known = _grams(known.join(F.broadcast(asked.select("length").distinct()), "length"), "h_")
    often = of_known.groupBy("gram", "number").agg(F.count("*").alias("often"))

    def rarest(grams: DataFrame, name: str, *keys: str) -> DataFrame:
        most = _most_edits(F.floor(F.length(name) / least), least)
        found = _shuffled(grams, often, ["gram", "number"], "left").groupBy(*keys, name, "length")
        rows = found.agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram", "number", "at"))), F.lit(1), 2 * most + 1).alias("few"))
        return rows.select(*keys, name, "length", F.explode("few").alias("g")).where("g.often > 0").select(*keys, name, "length", "g.gram", "g.number", F.col("g.at").alias(f"{name}at"))

    both = _shuffled(rarest(_grams(asked, "n_"), "n_"), rarest(of_known, "h_", "canonical"), ["gram", "number", "length"])
    return both.where(F.abs(F.col("n_at") - F.col("h_at")) <= _most_edits(F.greatest(F.length("n_"), F.length("h_")), least)).select("n_", "canonical", "h_")


def propose_hosts(names: DataFrame, hosts: DataFrame, least: float = 0.85, domains: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(name, canonical, score): the closest canonical of (canonical) for each name, by the names without suffixes and
    domains, exact first, ties alphabetical. Names that allow two edits at most meet on what is left of them without one edit,
    then, if none is that close, without two; longer ones meet on rare grams, and such pairs are compared by a bounded edit distance."""
    longest = max((n for n in range(1, 64) if int((1 - least) * n + 1e-9) <= 2), default=1)
    bare = lambda df, c, to: df.select(c, F.coalesce(bare_host(F.col(c), domains), F.lit("")).alias(to)).where(F.col(to) != "")
    lengths = lambda df, c: df.where(F.length(c) <= longest).agg(F.collect_set(F.length(c)).alias("lengths_"))
    spelt = bare(names, "name", "n_").distinct()
    known = bare(hosts, "canonical", "h_").groupBy("h_").agg(F.min("canonical").alias("canonical"))
    every = spelt.select("n_").distinct()
    of_names, of_hosts = lengths(every, "n_"), lengths(known, "h_")
    asked = _shuffled(every, known.withColumnRenamed("h_", "n_"), ["n_"], "left")
    exact = asked.where("canonical is not null").select("n_", F.struct(F.lit(-1.0).alias("s"), "canonical").alias("best"))
    asked = asked.where("canonical is null").select("n_")
    one = _by_edits(asked, known, 1, least, longest, of_names, of_hosts)
    #: Two edits never beat one, and tie with it in names of two characters alone.
    rest = _shuffled(asked, one, ["n_"], "left").where((F.length("n_") <= 2) | F.col("best").isNull()).select("n_")
    two = _by_edits(rest, known, 2, least, longest, of_names, of_hosts)
    most = F.greatest(F.length("n_"), F.length("h_"))
    far = _by_grams(asked, known, least, longest).withColumn("edits", F.call_function("levenshtein", F.col("n_"), F.col("h_"), _most_edits(most, least))).where("edits >= 0")  # -1: more than that
    far = far.withColumn("score", 1 - F.col("edits") / most).where(F.col("score") >= least - 1e-12).select("n_", F.struct((-F.col("score")).alias("s"), "canonical").alias("best"))
    best = exact.unionByName(one).unionByName(two).unionByName(far).groupBy("n_").agg(F.min("best").alias("best"))
    return _shuffled(spelt, best, ["n_"]).select("name", F.col("best.canonical").alias("canonical"), (-F.col("best.s")).alias("score"))


def fix_host(df: DataFrame, raw: str, new: str) -> DataFrame:
    """host.id of every row that names the host `raw`, also where it was missing."""
    return df.withColumn("host.id", F.when(quoted("host.name") == raw, F.lit(new)).otherwise(quoted("host.id")))
