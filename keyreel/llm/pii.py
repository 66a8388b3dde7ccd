"""Personal data: spans by pattern, and by a classifier trained with weak supervision.

Base spans are the leftmost, non-overlapping matches of each kind's pattern that pass its
test (email; ip: parts at most 255; card: 12 to 19 digits with a right check digit;
phone: 9 to 15 digits). Further candidates are the matches that fail, quoted or assigned
secrets (`token = "..."`) and masked mail addresses (`x [at] y [dot] z`). Four labelers vote
on every candidate, or abstain: its format, a gazetteer of names (domains, issuers,
country codes, words for keys), its context on both sides, and the variety of its
characters. Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability and each pattern's probability; on these a logistic regression over features of
the span is trained. Candidates that it accepts join the base spans, which always stay.

The counts of (kind, votes, features) come from all documents; there are at most 6 * 3**4 * 720
of them, whatever the input. They alone reach the driver, where both models are fitted. All
else is SQL functions: no Python runs on the executors.

Places of matches are running sums of the lengths of what lies between them, taken by blocks,
so a text with very many matches takes little more than its share of the time.

Offsets are code points, ends exclusive. Null texts are empty and have no spans, nor have
texts without a match. Spans of different kinds may overlap. The patterns' possessive forms
and anchors keep long runs of digits or letters linear, and match the same strings as the
plain forms. Repeated rows get equal results; an empty table gives an empty result, fitted
models then reject every further candidate. Other columns are ignored, or kept by redacted().
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyreel.llm.common import let, with_prefix

KINDS = ("email", "ip", "card", "phone", "secret", "masked")
#: A run can only begin where it is not preceded by its own characters, or where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"((?<![A-Za-z_])[A-Za-z_]{2,24}\s{0,3}[=:]\s{0,3}[\"']?)([A-Za-z0-9+/_-]{16,}+)",
    "masked": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[(][aA][tT][\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(][dD][oO][tT][\])]\x20?[A-Za-z0-9-]++)+",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": "[=:]", "masked": r"[\[(][aA][tT][\])]"}
#: No match of any kind is without one of these: most texts are turned to a Java string for this one search only.
ANY = r"[@0-9=:\[(]"
_MARK, _OTHER = "\x01", "\x02"
BLOCK = 256
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: The gazetteer, fixed values. General and country top domains:
_TOP_DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|io|ai|app|dev|cloud|online|site|tech|shop|me|tv|cc|co|"
    "ar|at|au|be|bg|br|ca|ch|cl|cn|cz|de|dk|ee|es|eu|fi|fr|gr|hk|hr|hu|id|ie|il|in|ir|is|it|jp|kr|li|lt|lu|lv|mx|my|"
    "nl|no|nz|pe|ph|pl|pt|ro|rs|ru|se|sg|si|sk|th|tr|tw|ua|uk|us|vn|za"
)
#: Country codes by world zone, as numbering plans deal them out:
_COUNTRY_CODES = r"1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9]"
#: Leading digits of the issuers of payment cards:
_ISSUERS = "4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|6(?:011|22|4[4-9]|5)|35(?:2[89]|[3-8])|5[06-8]|6[0-9]"
#: Words that name a secret:
_KEY_WORDS = (
    "token|secret|password|passwd|passphrase|passcode|pwd|pass|pin|key|apikey|api_key|access_key|secret_key|private_key|client_secret|"
    "access|auth|authorization|bearer|credential|credentials|session|sessionid|cookie|signature|salt|license_key|refresh_token|access_token"
)
#: First octets that no host has: this network, loopback, multicast and reserved ones.
_NO_HOSTS = "0+|127|22[4-9]|2[34][0-9]|25[0-5]"


def _matches(text: Column, kind: str) -> Column:
    """array<struct<s, e, v, l, r>>: start, end, value, up to 24 characters before it and one after it."""
    put = f"$1{_MARK}$2{_MARK}" if kind == "secret" else f"{_MARK}$0{_MARK}"
    # Even parts lie between matches, odd ones are matches.
    parts = F.split(F.regexp_replace(text, F.lit(PATTERNS[kind]), F.lit(put)), _MARK)

    def placed(p: Column) -> Column:
        def all_(before) -> Column:
            def one(j: Column) -> Column:
                i = j * 2 + 1
                s, v = before(i), F.get(p, i)
                return F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"), F.right(F.get(p, i - 1), F.lit(24)).alias("l"), F.left(F.get(p, i + 1), F.lit(1)).alias("r"))

            return F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), one)

        return with_prefix(F.transform(p, F.length), F.lit(0), lambda a, x: a + x, all_)

    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string,l:string,r:string>>)")
    some = let(parts, lambda p: F.when(F.size(p) > 1, placed(p)).otherwise(none))
    return F.when(F.rlike(text, F.lit(GATES[kind])), some).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _checked(d: Column) -> Column:
    """Whether the check digit of the digits d is right."""
    n = F.length(d)

    def add(a: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    d = _digits(v)
    if kind == "ip":
        return F.rlike(v, F.lit(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"))
    if kind == "card":
        return F.when(F.length(d).between(12, 19), _checked(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "secret":
        return F.rlike(v, F.lit("[0-9].*[0-9].*[0-9].*[0-9]")) & F.rlike(v, F.lit("[A-Za-z].*[A-Za-z].*[A-Za-z]"))
    return F.lit(True)


def _gazetteer(kind: str, v: Column, left: Column) -> Column:
    yes, no, none = F.lit(1), F.lit(0), F.lit(2)
    if kind in ("email", "masked"):
        return F.when(F.rlike(F.lower(v), F.lit(rf"\b(?:{_TOP_DOMAINS})$")), yes).otherwise(none)
    if kind == "card":
        return F.when(F.rlike(_digits(v), F.lit(rf"^(?:{_ISSUERS})")), yes).otherwise(none)
    if kind == "phone":
        return F.when(F.rlike(v, F.lit(rf"^\+(?:{_COUNTRY_CODES})")), yes).otherwise(none)
    if kind == "ip":
        return F.when(F.rlike(v, F.lit(rf"^(?:{_NO_HOSTS})\.")), no).otherwise(none)
    return F.when(F.rlike(F.lower(left), F.lit(rf"(?:{_KEY_WORDS})\s*[=:]\s*[\"']?$")), yes).otherwise(no)


def _side(c: Column) -> Column:
    """0: nothing or space, 1: letter or digit, 2: quote or bracket, 3: other."""
    return F.when((c == "") | F.rlike(c, F.lit(r"^\s")), 0).when(F.rlike(c, F.lit(r"^[\p{L}\p{N}]")), 1).when(F.rlike(c, F.lit(r"^[\"'()\[\]<>{}]")), 2).otherwise(3)


def candidates(text: Column) -> Column:
    """array<struct<kind, s, e, valid, votes, features>> of all kinds; votes and features are packed integers."""
    clean = F.coalesce(text.cast("string"), F.lit(""))
    clean = F.when(F.contains(clean, F.lit(_MARK)), F.translate(clean, _MARK, _OTHER)).otherwise(clean)

    def judge(k: int, kind: str):
        def judged(m: Column) -> Column:
            v, left = m["v"], m["l"]
            valid = _valid(kind, v)
            before, after = _side(F.right(left, F.lit(1))), _side(m["r"])
            variety = F.size(F.array_distinct(F.split(F.left(v, F.lit(64)), "")))
            length = F.length(v)
            fmt = F.when(valid, 1).otherwise(0)
            context = F.when((before == 1) | (after == 1), 0).otherwise(1)
            varied = F.when(variety <= 3, 0).when(variety >= 6, 1).otherwise(2)
            votes = fmt + 3 * _gazetteer(kind, v, left) + 9 * context + 27 * varied
            digits = F.floor(F.length(_digits(F.left(v, F.lit(64)))) * 4 / F.least(length, F.lit(64))).cast("int")  # 0 to 4
            bulk = F.when(length < 12, 0).when(length < 20, 1).when(length < 40, 2).otherwise(3)
            features = fmt + 2 * before + 8 * after + 32 * digits + 160 * bulk
            return F.struct(F.lit(k).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), valid.alias("valid"), votes.cast("int").alias("votes"), features.cast("int").alias("features"))

        return judged

    none = F.expr("cast(array() as array<struct<kind:int,s:int,e:int,valid:boolean,votes:int,features:int>>)")
    return F.when(F.rlike(clean, F.lit(ANY)), F.concat(*[F.transform(_matches(clean, kind), judge(k, kind)) for k, kind in enumerate(KINDS)])).otherwise(none)


def reliabilities(rows: list[tuple[int, int, float]], rounds: int = 60) -> dict[tuple[int, int], float]:
    """Probability of each (kind, votes) of the rows (kind, votes, count), by expectation-maximisation.

    Each labeler has a rate of voting right for either class; each kind has a prior."""
    votes = {(k, v): [v // 3**i % 3 for i in range(4)] for k, v, _ in rows}
    hit = [[0.8, 0.8] for _ in range(4)]  # right votes where personal, where not
    prior = {k: 0.5 for k, _, _ in rows}
    post: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for key, vs in votes.items():
            a, b = prior[key[0]], 1 - prior[key[0]]
            for (yes, no), v in zip(hit, vs):
                if v < 2:
                    a *= yes if v else 1 - yes
                    b *= 1 - no if v else no
            post[key] = a / (a + b) if a + b > 0 else 0.5
        for i in range(4):
            n = [[1.0, 1.0], [1.0, 1.0]]  # [personal or not][right or not], one of each to begin with
            for k, v, c in rows:
                x = votes[k, v][i]
                if x < 2:
                    p = post[k, v]
                    n[0][1 - x] += c * p
                    n[1][x] += c * (1 - p)
            hit[i] = [min(0.999, max(0.5, n[j][0] / (n[j][0] + n[j][1]))) for j in (0, 1)]
        for k in prior:
            own = [(c, post[kk, v]) for kk, v, c in rows if kk == k]
            prior[k] = min(0.98, max(0.02, (sum(c * p for c, p in own) + 1) / (sum(c for c, _ in own) + 2)))
    return post


_FEATURES = (("fmt", 1, 2), ("before", 2, 4), ("after", 8, 4), ("digits", 32, 5), ("bulk", 160, 4))


def _columns(kind: int, features: int) -> list[int]:
    at, base = [kind], len(KINDS)
    for _, unit, size in _FEATURES:
        at.append(base + features // unit % size)
        base += size
    return at


def span_classifier(rows: list[tuple[int, int, int, float]], post: dict[tuple[int, int], float], rounds: int = 300) -> list[float]:
    """Weights of a logistic regression of the probabilities on the one-hot features."""
    n = len(KINDS) + sum(size for _, _, size in _FEATURES)
    w = np.zeros(n)
    if rows:
        x = np.zeros((len(rows), n))
        for i, (k, _, f, _) in enumerate(rows):
            x[i, _columns(k, f)] = 1
        y = np.array([post[k, v] for k, v, _, _ in rows])
        c = np.array([r[3] for r in rows], float)
        c /= c.sum()
        for _ in range(rounds):  # Newton steps would do with fewer, but these can't diverge
            p = 1 / (1 + np.exp(-(x @ w)))
            w -= 2.0 * (x.T @ (c * (p - y)) + 1e-5 * w)
    return [float(v) for v in w]


class SpanModel:
    def __init__(self, weights: list[float]):
        self.weights = weights

    def spans(self, text: Column) -> Column:
        """array<struct<s, kind, e, base>>, sorted: base spans and accepted candidates."""
        table = F.array(*[F.lit(w) for w in self.weights])

        def accepted(x: Column) -> Column:
            total, base = F.get(table, x["kind"]), len(KINDS)
            for _, unit, size in _FEATURES:
                total = total + F.get(table, F.floor(x["features"] / unit).cast("int") % size + base)
                base += size
            return ((x["kind"] < 4) & x["valid"]) | (total > 0)

        kept = F.filter(candidates(text), accepted)
        return F.sort_array(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), ((x["kind"] < 4) & x["valid"]).alias("base"))))


def fit(docs: DataFrame) -> SpanModel:
    c = docs.select(F.explode(candidates(F.col("text"))).alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    rows = sorted((r.kind, r.votes, r.features, float(r.n)) for r in c.collect())  # bounded by the number of patterns
    by: dict[tuple[int, int], float] = {}
    for k, v, _, n in rows:
        by[k, v] = by.get((k, v), 0.0) + n
    return SpanModel(span_classifier(rows, reliabilities([(k, v, n) for (k, v), n in sorted(by.items())])))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of these, and all spans."""
    d = docs.select("doc_id", fit(docs).spans(F.col("text")).alias("sp"))
    base = F.filter("sp", lambda x: x["base"])
    count = lambda k: F.size(F.filter("sp", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return d.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("sp")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; n_chars follows."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text, sp = F.col("text").cast("string"), F.col("__sp")

    def replaced(c: Column, sp: Column) -> Column:
        """c: the text in blocks of BLOCK code points, so that reading at a place does not count from the start."""

        def between(p: Column, s: Column) -> Column:
            i, j = F.floor(p / BLOCK).cast("int"), F.floor(s / BLOCK).cast("int")
            first = lambda n: F.substring(F.get(c, i), p % BLOCK + 1, n)
            whole = F.array_join(F.slice(c, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
            more = F.concat(first(F.lit(BLOCK)), whole, F.coalesce(F.substring(F.get(c, j), F.lit(1), s % BLOCK), F.lit("")))
            return F.when(s <= p, F.lit("")).when(i == j, first(s - p)).otherwise(more)

        def all_(reached) -> Column:
            # A span that begins before the end of an earlier one is a part of what that one replaces.
            def one(x: Column, i: Column) -> Column:
                return F.when(x["s"] >= reached(i), F.concat(between(reached(i), x["s"]), F.get(names, x["kind"]))).otherwise("")

            total = F.lit(BLOCK) * (F.size(c) - 1) + F.length(F.element_at(c, -1))
            return F.concat(F.array_join(F.transform(sp, one), ""), between(reached(F.size(sp)), total))

        return with_prefix(F.transform(sp, lambda x: x["e"]), F.lit(0), F.greatest, all_)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))
    done = let(blocks, lambda c: let(sp, lambda x: replaced(c, x)))
    out = docs.withColumn("__sp", fit(docs).spans(F.col("text")))
    cols = [F.when(F.size("__sp") > 0, done).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = out.select(*cols)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
