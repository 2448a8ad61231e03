"""Secret scans with DataFrame functions only: base patterns, and character Markov models.

Base kinds are leftmost non-overlapping matches of fixed patterns; too short ones are dropped.
Positions come from the pieces between matches: split() and regexp_extract_all() run the same
pattern, so a match begins where the pieces and matches before it end.

The method adds kind `markov`: segments of runs of TOKEN characters outside base matches whose
log-likelihood ratio between a Markov model (first order, over printable ASCII) of random strings
and one of ordinary identifiers is LEAST bits or more. A segment begins where the running ratio
is at zero, stops at its peak, and is over when the ratio is at zero again or LEAST bits below the
peak; so a run may hold several, and what is ordinary beside a secret counts nothing. Letters and
digits on either side of a segment, up to a separator, are taken with it. Both models are
trained from labelled samples (`samples()` makes 2 * SAMPLE of them by rule); they meet as one
table of log ratios of 95 * 95 entries at most, which enters the plan as a literal.

Positions are in code points, ends exclusive. Null texts have no matches; empty tables give
empty results; repeated rows each get a row; other columns are kept as they are.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

# Fixed values of the contract: patterns and least lengths of the base kinds, in the order of kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
# What is run for a kind, where that is not its pattern: the same matches without those that are too
# short, since runs of one class end where they end, wherever in a run a match begins. (Not so for
# assign, whose short matches use up text that another match could begin in.)
RUN = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

#: Runs the Markov models judge, and the shortest: the least length of an assigned secret.
TOKEN, SHORTEST = r"[A-Za-z0-9+/_=-]", 12
#: Least log-likelihood ratio of a secret, in bits.
LEAST = 24.0
#: Labelled strings of each class that samples() makes.
SAMPLE = 20_000
STATES = 95
#: Share of each state's transitions that samples may not show.
UNSEEN = 0.02
#: Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "account address admin alpha amount array author backup balance binary block buffer button cache callback category channel char client close "
    "code collection color column command comment commit compare config connect content context control cookie count country create currency current "
    "customer data database date debug default delete description detail device display document download element email enable encode end error event "
    "example export field file filter find first folder font format frame function gateway global graph group handle header height history host image "
    "import index info input insert instance integer internal invoice item key label language last layer layout length level library limit line link "
    "list load local location log lookup manager mapping message method model module name network node number object offset option order output page"
).split()
IDENTIFIER_WORDS += (
    "pair panel parent parse password path payload permission pixel platform plugin point policy pool port position prefix price primary process product "
    "profile project property protocol provider proxy public publish quality quantity query queue quick quota quote radius random range rate read ready "
    "record recent redirect reference refresh region register release remote render replace report request require reset resource response result retry "
    "role root route row rule sample save scale schedule schema scope screen script scroll search section security select sequence serial server service "
    "session setting shadow share shift signal simple size slot sort source space special split stack stage start state static status step stop store "
    "stream string style submit summary support switch symbol sync system table target task template tenant text theme thread time title token tool total "
    "trace track traffic transfer tree trigger type unique unit update upload url usage user utility valid value vector version video view virtual visible "
    "volume wait warning watch web week weight widget width window word work wrap write year zero zip zone zoom adjust adaptive ajax apache async available "
    "awk basic beta bin bridge bytes canvas change cluster com css dev dist drive dropdown enum exact express extra factory fix flex fuzzy general gnu "
    "http html hybrid http java job join jquery json jump kernel lazy lib linux main major matrix max min mixin mixed net next node null obj org page "
    "png processing puzzle python question regex schwarz sha simplex spark sql src suffix svg tax toggle txt unix usr utf var vertex why wiki www xml xpath yield"
).split()
#: Words of prose in other languages, and common endings.
PROSE_WORDS = (
    "the that with and which when where would other nation through through thought eight light shall every have here there their about after again always "
    "tion ing ment able less ness ough wh sh th ed er ly hood ship hand stand hard width "
    "que los las una por para como esta donde cuando hacer ocho quien pero desde sobre hasta entre nuestro tiempo ciudad ando iendo mente cion dad "
    "les des une pour dans avec est sont vous nous leur aussi aux eux eau beaux deux jeux vieux oiseau autre elle quelque quand voix faire oui ait aient ment eur ique "
    "der die das und nicht auch sich mit auf ein eine wurde werden zwischen schon durch gesellschaft fahrt dampf schiff pfad kopf pflanze zehn zeit heit keit "
    "ung lich isch schaft katze pflicht ver zer be ge zu ich ach och euch zwei jahr jetzt"
).split()
#: Matches whose positions are summed up at once.
STRIDE = 256

_ARRAY = "array<struct<start:long,rank:int,kind:string,stop:long>>"


def _bind(value: Column, use) -> Column:
    """use(value) with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Array of (start, rank, kind, stop) of the matches whose group is `least` characters or more."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    enough = sizes if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x).cast("long"))
    both = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("n"), enough.alias("value")), lambda x: x["n"].isNotNull())

    def stretch(rows: Column, at: Column) -> Column:
        before = F.aggregate(F.slice(rows, 1, at), F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["n"])
        empty = F.lit(None).cast(_ARRAY)
        step = lambda a, x: F.struct(
            (a["pos"] + x["gap"] + x["n"]).alias("pos"),
            F.concat(a["out"], F.array(F.struct((a["pos"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.when(x["value"] >= least, a["pos"] + x["gap"] + x["n"]).alias("stop")))).alias("out"),
        )
        return F.aggregate(F.slice(rows, at + 1, F.lit(STRIDE)), F.struct(before.alias("pos"), F.coalesce(empty, F.array().cast(_ARRAY)).alias("out")), step)["out"]

    found = _bind(both, lambda rows: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / STRIDE).cast("int")), lambda c: stretch(rows, c * STRIDE))))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["stop"].isNotNull())).otherwise(F.array().cast(_ARRAY))


def samples(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """Labelled strings (string, secret): digests in common alphabets; identifiers in common styles, with numbers and of one
    letter's case, prose run together, dates, paths, numbers, alphabets, and rules of separators and of other single characters."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    alnum = F.regexp_replace(b64, "[+/=]", "")
    size = (F.pmod(F.xxhash64("id"), F.lit(21)) + 20).cast("int")
    text = F.element_at(F.array(digest, b64, F.translate(b64, "+/=", "-_"), F.upper(digest), alnum, F.lower(alnum), F.upper(alnum)), (F.pmod("id", F.lit(7)) + 1).cast("int"))
    random = ids.select(F.substring(text, F.lit(1), size).alias("string"), F.lit(True).alias("secret"))
    pick = lambda values, k: F.element_at(values, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.size(values)) + 1).cast("int"))
    words, prose = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " "), F.split(F.lit(" ".join(PROSE_WORDS)), " ")
    four = F.array(*[pick(words, k) for k in range(4)])
    caps = F.transform(four, lambda x: F.initcap(x))
    camel = F.concat(pick(words, "head"), F.array_join(caps, ""))
    run = F.array_join(F.array(*[pick(prose, f"p{k}") for k in range(4)]), "")
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(3000)).cast("string")
    short = F.pmod(F.xxhash64("id", F.lit("short")), F.lit(100)).cast("string")
    long = F.abs(F.xxhash64("id", F.lit("long"))).cast("string")
    when = F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit("t")), F.lit(2_000_000_000)))
    date = F.date_format(when, "yyyy-MM-dd")
    stamps = F.array(F.date_format(when, "yyyy-MM-dd'T'HH-mm-ss-SSSSSS"), F.date_format(when, "yyyy/MM/dd/"), F.date_format(when, "yyyyMMdd_HHmmss"), F.date_format(when, "yyyyMMdd'T'HHmmss'Z'"), F.concat(date, F.lit("_"), date))
    separators = F.split(F.lit("- _ = + / - _ = -= =- -+ +- --+ ---+ _- _/ // /- =+ -_"), " ")
    rule = F.repeat(pick(separators, "s"), 24)
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), F.pmod(F.xxhash64("id", F.lit("l")), F.lit(62)).cast("int") + 1, F.lit(1))
    alphabet = pick(F.array(F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("0123456789"), F.lit("qwertyuiopasdfghjklzxcvbnm")), "a")
    numbered = F.array_join(F.transform(four, lambda x: F.concat(x, short)), "_")
    styles = F.array(
        F.array_join(four, "_"),
        F.array_join(four, "-"),
        F.array_join(four, "/"),
        F.array_join(four, ""),
        F.upper(F.array_join(four, "_")),
        F.array_join(caps, ""),
        F.concat(F.array_join(four, "_"), F.lit("_"), number),
        camel,
        F.concat(F.lit("/"), F.array_join(caps, "/")),
        F.concat(F.lit("/"), F.array_join(four, "/"), F.lit("/"), number, F.lit("-"), pick(words, "tail")),
        F.concat(pick(stamps, "d"), F.lit("_"), pick(words, "tail")),
        F.concat(pick(words, "head"), F.lit("-"), pick(stamps, "d")),
        rule,
        F.concat(pick(words, "head"), F.substring(rule, 1, 8), pick(words, "tail")),
        F.repeat(letter, 150),
        alphabet,
        run,
        F.initcap(run),
        F.concat(F.upper(run), F.lit("_"), F.upper(pick(words, "tail"))),
        F.concat(numbered, F.lit("-v"), short, F.lit("-"), number),
        F.concat(F.initcap(pick(words, "head")), short, F.initcap(pick(words, "tail")), F.lit("V"), short),
        F.concat(F.upper(pick(words, "head")), F.array_join(caps, ""), F.lit("ID")),
        F.concat(F.upper(pick(words, "head")), F.lit("/"), short, F.lit("_"), number, F.lit("-"), F.upper(pick(words, "tail"))),
        F.concat(F.array_join(caps, "-"), F.lit("="), long),
        F.array_join(F.array(short, number, F.lit("x86"), short), "_"),
    )
    plain = ids.select(pick(styles, "style").alias("string"), F.lit(False).alias("secret"))
    return random.union(plain)


def _codes(string: Column) -> Column:
    """State of each character: 1 to 94 for printable ASCII, 0 before the first and for anything else."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(string, ""), lambda c: F.when(F.ascii(c).between(33, 126), F.ascii(c) - 32).otherwise(0)))


def _steps(codes: Column) -> Column:
    """Number of each transition, a * STATES + b, plus 1."""
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * STATES + b + 1)


def train(labelled: DataFrame) -> list[float]:
    """Log2 ratios of the transitions, from rows (string, secret), with add-half smoothing, and UNSEEN of each row's mass dealt evenly."""
    steps = labelled.where(F.length("string") > 0).select("secret", F.explode(_bind(_codes(F.col("string")), _steps)).alias("step"))
    counts = {(r.secret, r.step - 1): r.n for r in steps.groupBy("secret", "step").agg(F.count("*").alias("n")).collect()}  # 2 * STATES ** 2 rows at most
    total: dict[tuple[bool, int], float] = {}
    for (secret, step), n in counts.items():
        total[secret, step // STATES] = total.get((secret, step // STATES), 0) + n
    prob = lambda c, s: (1 - UNSEEN) * (counts.get((c, s), 0) + 0.5) / (total.get((c, s // STATES), 0) + 0.5 * STATES) + UNSEEN / STATES
    return [round(math.log2(prob(True, s) / prob(False, s)), 6) for s in range(STATES * STATES)]


def _segments(string: Column, ratios: Column, least: float) -> Column:
    """Segments (lo, hi) of a string whose log ratios add up to `least` or more, with the rest of the letters and digits at their ends."""
    values = F.transform(_bind(_codes(string), _steps), lambda s: F.element_at(ratios, s))
    kind = "struct<i:int,now:double,lo:int,best:double,hi:int,out:array<struct<lo:int,hi:int>>>"
    state = lambda i, now, lo, best, hi, out: F.struct(i.alias("i"), now.alias("now"), lo.alias("lo"), best.alias("best"), hi.alias("hi"), out.alias("out")).cast(kind)
    zero, none = F.lit(0), F.lit(0.0)
    out = lambda a: F.when(a["best"] >= least, F.concat(a["out"], F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        now, i = a["now"] + x, a["i"] + 1
        peak = now > a["best"]
        over = state(i, none, i, none, i, out(a))
        on = state(i, now, a["lo"], F.greatest(a["best"], now), F.when(peak, i).otherwise(a["hi"]), a["out"])
        return F.when((now <= 0) | (now <= a["best"] - least), over).otherwise(on)

    nullable = F.when(F.length(string) >= 0, state(zero, none, zero, none, zero, F.array().cast("array<struct<lo:int,hi:int>>")))
    found = F.aggregate(values, nullable, step, out)

    def whole(x: Column) -> Column:
        before = F.regexp_extract(string.substr(F.lit(1), x["lo"]), "(?<![A-Za-z0-9])[A-Za-z0-9]++$", 0)
        after = F.regexp_extract(string.substr(x["hi"] + 1, F.length(string)), "^[A-Za-z0-9]++", 0)
        return F.struct((x["lo"] - F.length(before)).alias("lo"), (x["hi"] + F.length(after)).alias("hi"))

    def join(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        one = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        meets = (F.size(a) > 0) & (x["lo"] <= last["hi"])
        return F.when(meets, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(one))).otherwise(F.concat(a, F.array(x))).cast("array<struct<lo:int,hi:int>>")

    return _bind(found, lambda f: F.when(F.size(f) == 0, f).otherwise(F.aggregate(F.transform(f, whole), F.slice(f, 1, 0), join)))


def _markov(text: Column, model: list[float], least: float) -> Column:
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folds into a literal
    pattern = f"{TOKEN}{{{SHORTEST},}}"
    strings = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = _bind(ratios, lambda t: F.transform(strings, lambda s: _segments(s, t, least)))
    kept = F.filter(F.arrays_zip(_placed(text, pattern, 0, 0, len(KINDS), "markov").alias("at"), judged.alias("in")), lambda x: F.size(x["in"]) > 0)
    span = lambda at, x: F.struct((at["start"] + x["lo"]).alias("start"), at["rank"].alias("rank"), at["kind"].alias("kind"), (at["start"] + x["hi"]).alias("stop"))
    spans = F.flatten(F.transform(kept, lambda x: F.transform(x["in"], lambda y: span(x["at"], y))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_ARRAY))


def _blanked(text: Column, spans: str) -> Column:
    """The text with spaces in place of its spans."""
    step = lambda a, x: F.struct(
        F.greatest(a["pos"], x["stop"]).alias("pos"),
        F.concat(
            a["out"],
            F.when(x["start"] > a["pos"], text.substr((a["pos"] + 1).cast("int"), (x["start"] - a["pos"]).cast("int"))).otherwise(""),
            F.repeat(F.lit(" "), F.greatest(x["stop"] - F.greatest(a["pos"], x["start"]), F.lit(0)).cast("int")),
        ).alias("out"),
    )
    done = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(_bind(done, lambda d: F.concat(d["out"], text.substr((d["pos"] + 1).cast("int"), F.length(text)))))


def base_scan(docs: DataFrame, text: str = "text", base: str = "base_spans") -> DataFrame:
    """`docs` with a column of the spans of the base patterns (start, rank, kind, stop), in order."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(base, F.array_sort(F.concat(*[_placed(body, RUN.get(kind, p), g, n, k, kind) for k, (kind, p, g, n) in enumerate(KINDS)])))


def scan(docs: DataFrame, model: list[float], text: str = "text", least: float = LEAST, base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """`docs` with two columns of spans (start, rank, kind, stop), in order: of the base patterns, and all."""
    found = base_scan(docs, text, base)
    found = found.withColumn("__rest", _blanked(F.coalesce(F.col(text), F.lit("")), base)).withColumn("__markov", _markov(F.col("__rest"), model, least))
    return found.withColumn(spans, F.when(F.size("__markov") == 0, F.col(base)).otherwise(F.array_sort(F.concat(F.col(base), F.col("__markov"))))).drop("__rest", "__markov")


def named(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text: str = "text", size: str | None = "n_chars", mark: str = "[SECRET]", **options) -> DataFrame:
    """`docs` with every span replaced by `mark` (overlapping spans by one); column `size`, if there, follows the new text."""
    found = scan(docs, model, text, base="__base", spans="__spans", **options)
    step = lambda a, x: F.struct(
        F.greatest(a["pos"], x["stop"]).alias("pos"),
        F.when(x["start"] < a["pos"], a["out"]).otherwise(F.concat(a["out"], F.col(text).substr((a["pos"] + 1).cast("int"), (x["start"] - a["pos"]).cast("int")), F.lit(mark))).alias("out"),
    )
    done = F.aggregate("__spans", F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out")), step)
    whole = _bind(done, lambda d: F.concat(d["out"], F.col(text).substr((d["pos"] + 1).cast("int"), F.length(F.col(text)))))
    hit = F.size("__spans") > 0
    out = found.withColumn("__text", F.when(hit, whole).otherwise(F.col(text)))
    columns = []
    for c, kind in docs.dtypes:
        if c == text:
            columns.append(F.col("__text").alias(c))
        elif c == size:
            columns.append(F.when(hit, F.length("__text").cast(kind)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def _digested(found: DataFrame, *more: Column) -> DataFrame:
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k[0]) for k in KINDS], F.sha2(named("base_spans"), 256).alias("base_sha256"), *more)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document: base kinds, and what the Markov models add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digested(scan(docs, train(samples(spark))), named("spans").alias("spans"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4 SQL can say: counts and digest of the base kinds."""
    return _digested(base_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _sql_kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of a kind in DuckDB, placed by the pieces between them."""
    pattern = pattern.replace("'", "''")
    return f"""select doc_id, {rank} as rank, '{kind}' as kind, value, before + match as stop, before as start from (
 select doc_id, value, len(m) as match, sum(len(gap)) over w + coalesce(sum(len(m)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as before
 from (select doc_id, i, g[i] as gap, m[i] as m, v[i] as value from (select doc_id, string_split_regex(body, '{pattern}') as g, regexp_extract_all(body, '{pattern}') as m, regexp_extract_all(body, '{pattern}', {group}) as v from t), unnest(range(1, len(m) + 1)) as u(i))
 window w as (partition by doc_id order by i)) where len(value) >= {least}"""


#: DuckDB folds case beyond ASCII, so letters of either case are classes here.
_SQL_PATTERNS = {"assign": re.sub("[a-z]+", lambda m: "".join(f"[{c}{c.upper()}]" for c in m[0]), "(password|passwd|secret|token|api_?key)") + ASSIGN[ASSIGN.index(r"""["']?"""):]}
BASE_SECRETS_SQL = f"""
with t as (select doc_id, coalesce(text, '') as body from documents),
s as ({" union all ".join(_sql_kind(k, kind, _SQL_PATTERNS.get(kind, p), g, n) for k, (kind, p, g, n) in enumerate(KINDS))}),
c as (select doc_id, {", ".join(f"count(*) filter (kind = '{k[0]}') as n_{k[0]}" for k in KINDS)}, string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, rank) as names from s group by doc_id)
select t.doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) as n_{k[0]}" for k in KINDS)}, sha256(coalesce(names, '')) as base_sha256 from t left join c using (doc_id)"""
