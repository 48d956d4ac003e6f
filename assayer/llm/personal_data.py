"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.native import let
from assayer.llm.shared import table

#: The base patterns, written so that a long run is read once: a match can only start where a run
#: of its first character class starts, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]*+"
LONE_SEPARATOR = r"[\x20-](?![0-9])|(?<![0-9])[\x20-]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Wider patterns whose matches are only candidates, by kind.
WIDER = {
    "account": r"(?<![0-9A-Za-z.,+-])[0-9]{8,19}(?![0-9A-Za-z.,-])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,64}){1,4}",
    "person": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Señora|Señor|Sra|Sr)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
KINDS = tuple(WIDER)
#: What a valid match of each kind looks like (shape labeler).
STRICT = {
    "account": r"^(?!0+$)(?!(?:19|20)[0-9]{6}(?:[0-9]{6})?$)(?!([0-9])\1+$)",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}(?!00|01|99)[0-9]{2}[\x20A-Z0-9]{11,}$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9]",
    "masked_email": r"^[A-Za-z0-9].*[A-Za-z]$",
    "person": r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
}
#: Gazetteers. First names; capitalised words that follow a title and name no person; lengths of bank account numbers by
#: country; endings of domains; numbers printed as examples; three digits that are no area code.
FIRST_NAMES = tuple(
    "Adam Aisha Alan Albert Alice Ana Andrea Andreas Angela Anna Anne Antonio Bernd Birgit Bruno Camille Carlos Carmen Charles Charlotte Christine Claire Claudia Daniel David Denis Diego Edward "
    "Elena Elizabeth Emily Emma Enrique Eric Eva Fatima Felix Fernando Francisco Frank Gabriel George Gerhard Hans Hans-Peter Heike Helen Helmut Henri Hugo Ingrid Isabel Jack Jacques James Jan "
    "Jane Javier Jean Jennifer Jens Joan John Jorge José Joseph Juan Julia Julie Jürgen Karen Karin Karl Katharina Kevin Klaus Laura Léa Linda Louis Lucía Luis Lukas Manfred Manuel Marco Maria "
    "María Marie Mario Mark Markus Martin Mary Matthias Michael Miguel Monika Nathalie Nicolas Nina Olivier Oscar Pablo Patricia Paul Pedro Peter Philippe Pierre Rafael Ralf Richard Robert Rosa "
    "Ruth Sabine Samuel Sandra Sara Sarah Sofía Sophie Stefan Stephen Susan Teresa Thomas Tim Ursula Uwe Victoria William Wolfgang Yves".split()
)
NOT_NAMES = tuple("President Chairman Chair Speaker Secretary Minister Director Professor Doctor Manager Officer Judge Bishop General Right Wrong Big Perfect Fix Robot Who Strange Clean Pepper Potato Street Avenue Road".split())
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
ENDINGS = tuple("com org net edu gov mil int info biz io co de fr es uk it nl be at ch pt pl se no dk fi ie us ca au nz jp cn in br mx eu".split())
EXAMPLES = ("123-45-6789", "078-05-1120", "219-09-9999", "111-11-1111", "123-12-1234", "987-65-4321")
NO_AREA = ("211", "311", "411", "511", "611", "711", "811", "911", "370", "371", "372", "373", "374", "375", "376", "377", "378", "379", "960", "961", "962", "963", "964", "965", "966", "967", "968", "969")
#: Words before a span that speak for it or against it (labeler of the words before), and words after it.
_BEFORE_FOR = {
    "account": r"account|acct|konto|compte|cuenta|card|karte|carte|tarjeta|customer|member|passport|patient|policy",
    "id": r"ssn|social|security|tax|tin|identification",
    "iban": r"iban|account|konto|compte|cuenta|bank|transfer|überweisung|virement",
    "local_phone": r"call|phone|tel|telephone|fax|mobile|cell|contact|reach|telefon|anruf|appelez|llame|dial|text",
    "masked_email": r"mail|e-mail|email|write|contact|reach|address|courriel|correo",
    "person": r"dear|by|from|with|contact|sincerely|regards|signed|patient|liebe|lieber|cher|chère|estimado|estimada",
}
_AGAINST_BEFORE = r"order|invoice|isbn|issn|sku|ref|version|page|pages|part|model|serial|ticket|case|item|figure|table|chapter|room|bestellung|rechnung|seite|facture|commande|pedido|factura|doi|build"
_AFTER = {
    "account": (r"^\x20?(?:at|with|bei|chez)(?!\p{L})", r"^\x20?(?:kg|km|m|bytes|items|units|pieces|times|people|users|eur|usd|rows|copies)(?!\p{L})"),
    "id": (r"^\x20?(?:issued|belongs)(?!\p{L})", r"^\x20?(?:pieces|units|rows)(?!\p{L})"),
    "iban": (r"^[,.]?\x20?(?:bic|swift|at|bei)(?!\p{L})", r"^\x20?(?:version|model)(?!\p{L})"),
    "local_phone": (r"^[,.]?\x20?(?:ext|extension|x[0-9]|or|between|after|before|anytime|today|now)", r"^\x20?(?:kg|km|units|pieces|items|usd|eur)(?!\p{L})"),
    "masked_email": (r"^[.,]?\x20?(?:for|if|or|to|with)(?!\p{L})", r"^\x20?(?:operator|syntax)(?!\p{L})"),
    "person": (r"^,?\x20(?:said|says|wrote|writes|lives|called|asked|told|sagte|schrieb|wohnt|dit|habite|dijo|vive|phone|born)(?!\p{L})", r"^,?\x20(?:street|avenue|road|hall|prize|award|show|movie)(?!\p{L})"),
}
#: Marks beside a span that speak against it.
MARK_BEFORE, MARK_AFTER = r"[#$€£=/|<>_]\x20?$", r"^\x20?[%€$£=|<>_/]"
#: Labelers: shape, gazetteer, words before, words after, marks beside, nearness of a base span, density of digits around.
LABELERS = 7
#: Further features of a span and its context, hashed into BUCKETS each: shape, word before, word after, length, place in its line.
FEATURES, BUCKETS = 5, 256
SLOTS = LABELERS + FEATURES
#: Characters of context on each side, those within which a base span is near, and the probability from which a candidate is added.
CONTEXT, NEAR, ACCEPT = 40, 100, 0.5
#: Matches whose places are summed up at once.
RUN = 1024
SPAN = "array<struct<start:int,stop:int,match:string>>"
CANDIDATE = "array<struct<kind:string,start:int,stop:int,votes:int,features:array<int>>>"


def located(text: Column, pattern: str, context: int = 0) -> Column:
    """Array of (start, stop, match), in code points, of the leftmost non-overlapping matches: what lies between
    them gives the places. Places are summed up in runs, so that many matches don't cost their square.

    With ``context`` also (before, after): up to so many characters on each side, no further than the next match of the pattern.
    They are cut from what lies between, since a cut out of the text would count its characters from the start each time."""
    kind = SPAN.replace(">>", ",before:string,after:string>>") if context else SPAN

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["match"])
        sides = [F.right(pair["gap"], F.lit(context)).alias("before"), F.left(pair["next"], F.lit(context)).alias("after")] if context else []
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), pair["match"].alias("match"), *sides))
        return F.struct(stop.alias("at"), F.concat(acc["out"], one).alias("out"))

    def placed(pairs: Column, at: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add)

    def runs(pairs: Column) -> Column:
        def more(acc: Column, n: Column) -> Column:
            own = F.slice(pairs, n * RUN + 1, F.lit(RUN))
            return let(placed(own, acc["at"]), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out")))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        many = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), zero, more, lambda acc: acc["out"])
        return F.when(F.size(pairs) <= RUN, placed(pairs, F.lit(0))["out"]).otherwise(many)

    def zipped(x: Column) -> Column:
        n = F.size(x["matches"])
        pairs = F.zip_with(x["matches"], F.slice(x["gaps"], F.lit(1), n), lambda m, g: F.struct(g.alias("gap"), m.alias("match")))
        if context:
            pairs = F.zip_with(pairs, F.slice(x["gaps"], F.lit(2), n), lambda p, g: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), g.alias("next")))
        return let(pairs, runs)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps")), zipped)


def luhn(digits: Column) -> Column:
    doubled = F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))

    def add(acc: Column, i: Column) -> Column:
        value = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.get(doubled, value)).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _part(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of a non-null text by kind. Each pattern runs only on texts that can hold a match."""
    none = F.array().cast(SPAN)
    joined = F.regexp_replace(text, LONE_SEPARATOR, "x")
    return {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        "ip": F.when(F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), F.filter(located(text, IP), lambda s: F.forall(F.split(s["match"], r"\."), _part))).otherwise(none),
        "card": F.when(
            F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
            F.filter(let(joined, lambda t: located(t, CARD)), lambda s: F.length(_digits(s["match"])).between(13, 19) & luhn(_digits(s["match"]))),
        ).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda s: F.length(_digits(s["match"])).between(9, 15))).otherwise(none),
    }


def _vote(for_: Column, against: Column) -> Column:
    """2 for, 0 against, 1 abstains."""
    return F.when(for_, 2).when(against, 0).otherwise(1)


def _like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def _remainder(digits: Column) -> Column:
    """The number that a string of digits spells, modulo 97."""
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: (acc * 10 + F.substring(digits, i, F.lit(1)).cast("int")) % 97)


def _iban_vote(match: Column) -> Column:
    """For a known country, its length and a right checksum; against otherwise."""
    lengths = F.create_map(*(F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv))

    def of(bare: Column) -> Column:
        turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
        digits = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
        right = F.coalesce(F.try_element_at(lengths, F.substring(bare, 1, 2)) == F.length(bare), F.lit(False))
        return _vote(right & (_remainder(digits) == 1), F.lit(True))

    return let(F.replace(match, F.lit(" "), F.lit("")), of)


def _gazetteer(kind: str, match: Column) -> Column:
    """What the lists of a kind say of a match."""
    if kind == "iban":
        return _iban_vote(match)
    if kind == "account":
        return _vote(F.lit(False), luhn(match) & (F.length(match) < 13) | F.length(match).isin(13, 10) & _like(match, "^(?:97[89]|1[0-9]{9}$)"))
    if kind == "id":
        return _vote(F.lit(False), match.isin(*EXAMPLES))
    if kind == "local_phone":
        bare = _digits(match)
        return _vote(F.lit(False), F.substring(bare, 1, 3).isin(*NO_AREA) | _like(bare, "^...55501"))
    if kind == "masked_email":
        ending = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
        return _vote(ending.isin(*ENDINGS), ~ending.isin(*ENDINGS))
    first = F.regexp_extract(match, r"\x20(\p{Lu}\p{Ll}+)", 1)
    return _vote(first.isin(*FIRST_NAMES), first.isin(*NOT_NAMES) | F.regexp_extract(match, r"(\p{Lu}\p{Ll}+)$", 1).isin(*NOT_NAMES))


def _ballots(kind: str, s: Column, before: Column, after: Column, base: Column) -> list[Column]:
    for_, against = _AFTER[kind]
    near = F.exists(base, lambda b: (b["start"] < s["stop"] + NEAR) & (b["stop"] > s["start"] - NEAR))
    around = F.concat(before, after)
    dense = F.length(F.regexp_replace(around, "[^0-9]", "")) * 3 > F.length(around)
    return [
        F.when(_like(s["match"], STRICT[kind]), 2).otherwise(0),
        _gazetteer(kind, s["match"]),
        _vote(_like(before, rf"(?i)(?<!\p{{L}})(?:{_BEFORE_FOR[kind]})\P{{L}}{{0,12}}$"), _like(before, rf"(?i)(?<!\p{{L}})(?:{_AGAINST_BEFORE})\P{{L}}{{0,6}}$")),
        _vote(_like(after, f"(?i){for_}"), _like(after, f"(?i){against}")),
        _vote(F.lit(False), _like(before, MARK_BEFORE) | _like(after, MARK_AFTER)),
        _vote(near, F.lit(False)),
        _vote(F.lit(False), dense),
    ]


def _features(match: Column, before: Column, after: Column) -> Column:
    """Buckets of what the classifier sees besides the votes."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, "[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    word = lambda text, pattern: F.lower(F.regexp_extract(text, pattern, 1))
    starts, ends = F.when((before == "") | _like(before, r"\n$"), "1").otherwise("0"), F.when((after == "") | _like(after, r"^[.,]?\n"), "1").otherwise("0")
    values = (shape, word(before, r"(\p{L}+)\P{L}*$"), word(after, r"^\P{L}*(\p{L}+)"), F.length(match).cast("string"), F.concat(starts, ends))
    return F.array(*(F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int") for v in values))


def candidates(text: Column, base: Column) -> Column:
    """Array of (kind, start, stop, votes, features): matches of the wider patterns that overlap no base span. votes holds LABELERS
    digits to base 3, features the buckets of the span and its context."""

    def of(kind: str, pattern: str) -> Column:
        def span(s: Column) -> Column:
            votes = _ballots(kind, s, s["before"], s["after"], base)
            total = sum((b * 3**i for i, b in enumerate(votes[1:], 1)), votes[0])
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), total.alias("votes"), _features(s["match"], s["before"], s["after"]).alias("features"))

        free = F.filter(located(text, pattern, CONTEXT), lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"])))
        return F.when(_like(text, pattern), F.transform(free, span)).otherwise(F.array().cast(CANDIDATE))

    return F.concat(*(of(k, p) for k, p in WIDER.items()))


def ballots(votes: int) -> tuple[int, ...]:
    return tuple(votes // 3**i % 3 for i in range(LABELERS))


def reliabilities(counts: dict[tuple[str, int], int], rounds: int = 50) -> dict[tuple[str, int], float]:
    """The probability that a span of each (kind, votes) is personal data, by expectation-maximisation (Dawid and Skene, 1979)
    over the distinct vote patterns of each kind, at most 3**LABELERS of them however large the corpus: it estimates, for
    each kind and labeler, how often it votes each way on true and on false spans. Pseudocounts say that votes
    for are likelier on true spans, which keeps the two classes from changing places."""
    out = {}
    for kind in sorted({k for k, _ in counts}):
        own = {v: n for (k, v), n in sorted(counts.items()) if k == kind}
        share = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(b - 1 for b in ballots(v)))) for v in own}
        for _ in range(rounds):
            prior = [1.0, 1.0]
            rate = [[[3.0, 2.0, 1.0] for _ in range(LABELERS)], [[1.0, 2.0, 3.0] for _ in range(LABELERS)]]
            for v, n in own.items():
                for y, p in ((1, share[v]), (0, 1 - share[v])):
                    prior[y] += n * p
                    for i, b in enumerate(ballots(v)):
                        rate[y][i][b] += n * p
            for v in own:
                odds = math.log(prior[1] / prior[0])
                for i, b in enumerate(ballots(v)):
                    odds += math.log(rate[1][i][b] / sum(rate[1][i])) - math.log(rate[0][i][b] / sum(rate[0][i]))
                share[v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        out |= {(kind, v): p for v, p in share.items()}
    return out


def _slots() -> Column:
    """The places, in one array of weights, of what the classifier sees of a candidate ``c``: its votes and its features."""
    kind = F.array_position(F.lit(list(KINDS)), F.col("c.kind")).cast("int") - 1
    digits = [F.floor(F.col("c.votes") / 3**i).cast("int") % 3 for i in range(LABELERS)]
    values = [*digits, *(F.get(F.col("c.features"), F.lit(i)) for i in range(FEATURES))]
    return F.array(*((kind * SLOTS + i) * BUCKETS + v for i, v in enumerate(values)))


def classifier(wider: DataFrame, chance: dict[tuple[str, int], float]) -> list[float]:
    """Weights of the span classifier for candidates (c), one a slot value of each kind and then a prior for each kind: naive Bayes,
    trained on all candidates with the probabilities of their votes as labels. What reaches the driver is one sum a weight."""
    spark = wider.sparkSession
    told = spark.createDataFrame([(k, v, p) for (k, v), p in sorted(chance.items())], "kind string, votes int, p double")
    labelled = wider.join(F.broadcast(told), (F.col("c.kind") == F.col("kind")) & (F.col("c.votes") == F.col("votes")))
    sums = labelled.select("p", F.explode(_slots()).alias("slot")).groupBy("slot").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    out, prior = [0.0] * (len(KINDS) * SLOTS * BUCKETS), [[1.0, 1.0] for _ in KINDS]
    found = {r["slot"]: (r["yes"], r["no"]) for r in sums.collect()}
    for slot, (yes, no) in found.items():
        if slot // BUCKETS % SLOTS == 0:
            prior[slot // BUCKETS // SLOTS][0] += yes
            prior[slot // BUCKETS // SLOTS][1] += no
    for slot, (yes, no) in found.items():
        all_yes, all_no = prior[slot // BUCKETS // SLOTS]
        # one pseudocount a class, spread in proportion to the classes: a value seen once says little
        out[slot] = math.log((yes + all_yes / (all_yes + all_no)) / all_yes) - math.log((no + all_no / (all_yes + all_no)) / all_no)
    return out + [math.log(a / b) for a, b in prior]


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, base, added) for each row of (doc_id, text): arrays of (kind, start, stop), by kind as listed, then start.

    ``base`` has what the base patterns give, always kept. ``added`` has the spans of the wider kinds that the final
    classifier gives at least ``accept``. Texts are read once: their spans and votes, all that later steps need, are written to
    the shared folder; only counts of vote patterns and sums for the classifier reach the driver. Null texts count as
    empty and have no spans; repeated rows each come back; extra columns are ignored; an empty table gives an empty result.
    """
    kind = "array<struct<kind:string,start:int,stop:int>>"
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = own.select("doc_id", "text", F.struct(*(c.alias(k) for k, c in base_spans(F.col("text")).items())).alias("found"))
    listed = F.concat(*(_named(F.col(f"found.{k}"), k) for k in BASE))
    voted = found.select("doc_id", let(listed, lambda b: F.struct(b.cast(kind).alias("base"), candidates(F.col("text"), b).cast(CANDIDATE).alias("wider"))).alias("spans"))
    voted = table(voted.select("doc_id", "spans.base", "spans.wider"), "spans")
    wider = voted.select(F.explode("wider").alias("c"))
    counted = wider.groupBy("c.kind", "c.votes").count()
    chance = reliabilities({(r["kind"], r["votes"]): r["count"] for r in counted.collect()})
    if not chance:
        return voted.select("doc_id", "base", F.array().cast(kind).alias("added"))
    weights = voted.sparkSession.createDataFrame([(classifier(wider, chance),)], "weights array<double>")
    first = len(KINDS) * SLOTS * BUCKETS

    def odds(c: Column) -> Column:
        at = F.array_position(F.lit(list(KINDS)), c["kind"]).cast("int") - 1
        seen = [F.floor(c["votes"] / 3**i).cast("int") % 3 for i in range(LABELERS)] + [F.get(c["features"], F.lit(i)) for i in range(FEATURES)]
        return sum((F.get("weights", (at * SLOTS + i) * BUCKETS + v) for i, v in enumerate(seen)), F.get("weights", at + first))

    taken = F.filter("wider", lambda c: odds(c) >= math.log(accept / (1 - accept)))
    added = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    return voted.crossJoin(F.broadcast(weights)).select("doc_id", "base", added.cast(kind).alias("added"))


def rendered(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
