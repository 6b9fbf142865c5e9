"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from strict patterns and from looser ones.  Five labelers (the strict
rule, the characters on both sides, gazetteer, cue words before, misleading words before)
vote on each; the
reliability of every labeler is estimated by expectation-maximisation over the
counts of the vote patterns; the resulting probabilities train a naive Bayes span
classifier, which judges the candidates that the strict rules do not settle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.session import materialize

KINDS = ("email", "ip", "card", "phone", "number", "person")
BASE = KINDS[:4]
LABELERS = 5
ROUNDS = 25
AROUND = 40
#: Matches that are gathered at once; the work of a text grows with this, not with its matches.
CHUNK = 256
CUT = 0.0

# A run starts where the previous character is not of the run, or where the last
# match ended (\G); possessive repeats keep the time linear in the text, and a first
# look at the next character saves most of the work.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_NUMBER = r"(?=[0-9(])(?<![0-9A-Za-z+.,/-])\(?[0-9]{3}\)?[\x20-][0-9]{2,3}[\x20-][0-9]{4}(?![0-9A-Za-z-])"
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?"
_GIVEN = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Hans|Peter|Klaus|"
    "Sabine|Ursula|Jean|Pierre|Marie|Nathalie|Isabelle|José|María|Carmen|Juan|Antonio|Francisco"
)
_PERSON = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}|{_GIVEN})\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?+(?!\p{{L}})"
_PATTERNS = dict(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE, _NUMBER, _PERSON)))
_NEEDS = {"email": "@", "phone": "+"}

_GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?:10|127|172|192)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|52|54|55|61|81|86|91)",
    "number": r"^\(?[2-9][0-9]{2}",
    "person": rf"^(?:{_GIVEN})\x20",
}
# What stands on both sides of a value that is written on its own.
_OPENED = r"(?:^|[\s\"'(\[{<:;,=|])$"
_CLOSED = r"^(?:$|[\s\"')\]}>;|]|[.,:!?](?:\s|$))"
_CUE = (
    r"(?i)(?:e-?mail|mailto|contact|phone|tel|mobile|call|fax|card|visa|mastercard|credit|iban|account|ssn|"
    r"social security|passport|\bip\b|address|host|server|name|kontakt|telefon|correo|courriel)"
)
_MISLEADING = r"(?i)(?:version|isbn|issn|doi|order|invoice|ref|figure|page|chapter|section|total|build|release)"
_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; in a lambda it would be computed for
    every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column) -> Column:
    """A list as lists of up to ``CHUNK`` items."""
    last = F.ceil(F.size(items) / CHUNK).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(cut, 1, 0))


def _starts(chunks: Column) -> Column:
    """Where in the text each chunk of matches begins."""
    length = lambda total, x: total + F.length(x["around"]["before"]) + F.length(x["match"])
    sizes = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), length))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))

    def add(state: Column, size: Column) -> Column:
        return F.struct((state["at"] + size).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    return F.aggregate(sizes, none, add, lambda state: state["out"])


def _matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches: start, end, the match, and what surrounds it."""
    pattern = F.lit(_PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(
        found,
        F.zip_with(
            F.slice(gaps, 1, F.size(found)),
            F.slice(gaps, 2, F.size(found)),
            lambda before, after: F.struct(before.alias("before"), after.alias("after")),
        ),
        lambda match, around: F.struct(match.alias("match"), around.alias("around")),
    )
    item = "struct<start:long,end:long,match:string,before:string,after:string>"

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["around"]["before"])
        end = start + F.length(x["match"])
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            x["match"].alias("match"),
            F.substring(x["around"]["before"], -AROUND, AROUND).alias("before"),
            F.substring(x["around"]["after"], 1, AROUND).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    empty = F.array().cast(f"array<{item}>")

    def chunk_spans(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("spans")), place, lambda state: state["spans"])

    def all_spans(zipped: Column) -> Column:
        # Growing one list match by match would copy it every time.
        return _bound(
            _chunks(zipped),
            lambda chunks: F.flatten(F.zip_with(chunks, _starts(chunks), chunk_spans)),
        )

    spans = _bound(zipped, all_spans)
    some = text.rlike(_PATTERNS[kind])
    if kind in _NEEDS:
        some = text.contains(_NEEDS[kind]) & some
    return F.when(some, spans).otherwise(empty)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _settled(kind: str, match: Column) -> Column:
    """Whether a match meets the strict rule of its kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(_PARTS)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(False)


def _candidates(text: Column, kind: str) -> Column:
    """Candidates of a kind, with votes in -1, 0, 1 and features for the classifier."""
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)

    def candidate(span: Column) -> Column:
        match, before = span["match"], span["before"]
        base = _settled(kind, match)
        strict = kind in BASE
        closed = before.rlike(_OPENED) & span["after"].rlike(_CLOSED)
        votes = F.array(
            vote(base, ~base) if strict else F.lit(0),
            vote(closed, ~closed),
            vote(match.rlike(_GAZETTEER[kind])),
            vote(before.rlike(_CUE)),
            vote(F.lit(False), before.rlike(_MISLEADING)),
        )
        bucket = lambda text, name: F.concat(
            F.lit(name), F.pmod(F.xxhash64(F.lower(text)), F.lit(32)).cast("string")
        )
        shape = F.concat(F.lit(f"{kind}:"), F.least(F.length(match), F.lit(24)).cast("string"))
        state = F.concat(F.lit(f"{kind}="), base.cast("string"))
        features = F.array(
            F.lit(kind),
            shape,
            state,
            bucket(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1), "before"),
            bucket(F.regexp_extract(span["after"], r"^\P{L}*(\p{L}+)", 1), "after"),
        )
        return F.struct(
            span["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            span["end"].alias("end"),
            base.alias("base"),
            votes.alias("votes"),
            features.alias("features"),
        )

    return F.transform(_matches(text, kind), candidate)


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and the candidates of every row, by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(_candidates(text, kind) for kind in KINDS))
    return documents.select(F.col("doc_id").cast("long"), F.array_sort(found).alias("found"))


def _reliabilities(patterns: DataFrame) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern, by expectation-maximisation.

    ``patterns`` has the columns votes and n, at most 3 ** LABELERS rows.  All
    rounds are one expression over the one row that holds them.
    """
    parameters = LABELERS * 6  # labeler, class, vote
    state = "named_struct('prior', 0.5D, 'theta', {})"
    first = ", ".join(
        f"{p}D" for _ in range(LABELERS) for p in (0.6, 0.3, 0.1, 0.1, 0.3, 0.6)
    )
    odds = (
        "ln(s.prior / (1D - s.prior)) + aggregate(sequence(0, {last}), 0D, (a, l) -> a"
        " + ln(s.theta[l * 6 + 4 + p.votes[l]]) - ln(s.theta[l * 6 + 1 + p.votes[l]]))"
    ).format(last=LABELERS - 1)
    judged = f"transform(patterns, p -> named_struct('votes', p.votes, 'n', p.n, 'y', 1D / (1D + exp(-({odds})))))"
    weight = "(IF(int(k / 3) % 2 = 1, q.y, 1D - q.y) * q.n)"
    share = (
        "(aggregate(j.posts, 1D, (a, q) -> a + IF(q.votes[int(k / 6)] = k % 3 - 1, {w}, 0D)))"
        " / (aggregate(j.posts, 3D, (a, q) -> a + {w}))"
    ).format(w=weight)
    prior = "(aggregate(j.posts, 1D, (a, q) -> a + q.y * q.n) / aggregate(j.posts, 2D, (a, q) -> a + q.n))"
    update = (
        f"transform(array(named_struct('posts', {judged})), j -> named_struct('prior', {prior},"
        f" 'theta', transform(sequence(0, {parameters - 1}), k -> {share})))[0]"
    )
    fitted = f"aggregate(sequence(1, {ROUNDS}), {state.format(f'array({first})')}, (s, r) -> {update})"
    row = (
        patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
        .select("patterns", F.expr(fitted).alias("s"))
        .select(F.expr(judged).alias("judged"))
        .first()
    )
    return {tuple(p["votes"]): p["y"] for p in row["judged"] or []}


def _weights(found: DataFrame, probability: dict[tuple[int, ...], float]) -> tuple[float, dict[str, float]]:
    """Prior log odds and the log odds of each feature, from the probabilities."""
    text = lambda votes: F.array_join(F.transform(votes, lambda v: v.cast("string")), ",")
    table = F.create_map(*(F.lit(x) for votes, y in probability.items() for x in (",".join(map(str, votes)), y)))
    judged = found.select("features", table[text(F.col("votes"))].alias("y"))
    totals = judged.agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).select(
        F.log((F.col("yes") + 1) / (F.col("no") + 1)).alias("prior"), "yes", "no"
    ).first()
    rows = (
        judged.select(F.explode("features").alias("feature"), "y")
        .groupBy("feature")
        .agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
        .select(
            "feature",
            F.log(
                (F.col("yes") + 1) / (F.lit(totals["yes"]) + 2) / ((F.col("no") + 1) / (F.lit(totals["no"]) + 2))
            ).alias("weight"),
        )
        .collect()
    )
    return totals["prior"], {r["feature"]: r["weight"] for r in rows}


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, spans and base_spans (lists of start, kind number, end) for every row.

    Strict matches always stay; of the other candidates those stay that the
    classifier favours and that overlap no strict match.  A null text counts as
    empty; repeated rows are judged one by one; without any candidate nothing is
    trained.  Only the counts of vote patterns (at most 243) and of features (some
    250) reach the driver.
    """
    rows = materialize(candidates(documents), "candidates")
    found = rows.select(F.explode("found").alias("c")).select("c.votes", "c.features")
    probability = _reliabilities(found.groupBy("votes").agg(F.count("*").alias("n")))
    accepted = lambda c: c["base"]
    if probability:
        prior, weights = _weights(found, probability)
        table = F.create_map(*(F.lit(x) for item in sorted(weights.items()) for x in item))

        def accepted(c: Column) -> Column:
            score = F.aggregate(c["features"], F.lit(prior), lambda a, f: a + F.coalesce(table[f], F.lit(0.0)))
            return c["base"] | (score > CUT)

    base = F.filter("found", lambda c: c["base"])

    def free(chunks: Column) -> Column:
        """The accepted candidates that overlap no strict match: a chunk of these is looked
        into only where its whole stretch is met."""

        def meets(c: Column) -> Column:
            inside = lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
            return F.exists(chunks, lambda chunk: inside(chunk) & F.exists(chunk["spans"], inside))

        return F.filter(F.filter("found", accepted), lambda c: c["base"] | ~meets(c))

    stretches = lambda chunks: F.transform(
        chunks,
        lambda chunk: F.struct(
            chunk.alias("spans"),
            F.array_min(F.transform(chunk, lambda b: b["start"])).alias("start"),
            F.array_max(F.transform(chunk, lambda b: b["end"])).alias("end"),
        ),
    )
    spans = _bound(_bound(base, lambda b: stretches(_chunks(b))), free)
    brief = lambda spans: F.transform(
        spans, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    )
    return rows.withColumn("base", base).select(
        "doc_id", brief(spans).alias("spans"), brief(F.col("base")).alias("base_spans")
    )


def digests(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    names = F.array(*(F.lit(kind) for kind in KINDS))
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    )
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(line(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
