"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from three sides: the four base patterns, gazetteers (known forms of keys, spelt-out addresses, local
numbers) and context (the value named by a word such as password). Five labelers vote on each or abstain: the base
rule on forms that it can judge, gazetteers, words around, shape, and borders. Votes are counted by pattern, at most
9 * 3**5 whatever the input; expectation-maximisation on these counts estimates how reliable each labeler is and how
likely each pattern is personal data. These soft labels train the final span classifier, a logistic one on other
features than the votes: form, size, checksum, the word before and the characters next to the span. Votes and
classifier together judge what the base rules do not take. Base spans always stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, let, scan, without, written

KINDS = ("email", "ip", "card", "phone", "secret")
OWN = ("base_spans", "all_spans")
# The base patterns, with possessive repeats and borders that change no match but bound the search.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Fixed values, further forms: a spelt-out address, an address of eight hexadecimal groups, a number without country
# code or with 00 before it, known forms of keys.
EMAIL_SPELT = rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\(at\)|\[at\]) ?{_LABEL}++(?: ?(?:\(dot\)|\[dot\]|\.) ?{_LABEL}++)++"
IP_SIX = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
PHONE_LOCAL = r"(?<![0-9+.()-])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]?(?:[ .-][0-9]{2,4}){3,4})(?![0-9])"
KEY = r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[0-9A-Za-z-]{10,80}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+)(?![A-Za-z0-9_-])"
SECRET_WORDS = "password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential"
TOLD = rf"(?i)(?<=(?:{SECRET_WORDS})[\x22']?[ ]{{0,3}}[=:][ ]{{0,3}}[\x22']?)[^\s\x22'=:,;]{{6,200}}+"
#: Which kind each form is of: the four base patterns, then the further ones.
FORM_KINDS = (0, 1, 2, 3, 0, 1, 3, 4, 4)
# The gazetteers and the words of the context labeler.
DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|it|nl|eu|ch|at|us|ca|au"
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUER = r"4|5[1-5]|2[2-7]|3[0-9]|6"
RESERVED = r"(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
PLACEHOLDER = r"(?i)^(?:x+|\*+|\.+|your.*|example.*|changeme|none|null|undefined|true|false)$"
FOR = {
    "email": r"(?i)e-?mail|mail|contact|write|address|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login|client|visitor|adresse",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta|\bcc\b",
    "phone": r"(?i)phone|call|tel|mobile|cell|fax|dial|contact|telefon|tél|móvil",
    "secret": rf"(?i)(?:{SECRET_WORDS})[\x22']?[ ]{{0,3}}[=:]",
}
AGAINST = r"(?i)isbn|issn|version|order|invoice|serial|section|chapter|total|\bid\b|\bno\.|doi|figure|table|checksum|sha|commit"
AROUND = 24
LABELERS = ("rule", "gazetteer", "context", "shape", "border")
#: Buckets of the word before a span, and the values of the classifier's features: form, size, checksum, that word, the
#: characters before and after.
WORDS = 64
FEATURES = {"f": len(FORM_KINDS), "size": 8, "luhn": 2, "prev": WORDS, "bc": 4, "ac": 4}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _found(text: Column, guard: Column, pattern: str, form: int, passes) -> Column:
    """Matches of ``pattern`` as structs with places in code points. ``passes``: whether a match is of the base."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<f:int,k:int,s:bigint,e:bigint,base:boolean,x:string,b:string,a:string>>")

    def placed(m: Column) -> Column:
        def spans(gaps: Column) -> Column:
            # A match ends after all gaps and matches up to it; what stands around it is read from the gaps beside it.
            ends = scan(F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long")), 0, lambda a, b: a + b)
            sides = F.zip_with(F.slice(gaps, 1, F.size(m)), F.slice(gaps, 2, F.size(m)), lambda a, b: F.struct(F.right(a, F.lit(AROUND)).alias("b"), F.left(b, F.lit(AROUND)).alias("a")))
            seen = F.zip_with(m, sides, lambda x, z: F.struct(x.alias("x"), z["b"].alias("b"), z["a"].alias("a")))
            span = lambda z, e: F.struct(F.lit(form).alias("f"), F.lit(FORM_KINDS[form]).alias("k"), (e - F.length(z["x"])).alias("s"), e.alias("e"), passes(z["x"]).alias("base"), z["x"].alias("x"), z["b"].alias("b"), z["a"].alias("a"))
            return F.zip_with(seen, ends, span)

        return F.when(F.size(m) == 0, empty).otherwise(let(F.split(text, pattern, -1), spans))

    return F.when(guard, let(found, placed)).otherwise(empty)


def _candidates(text: Column) -> Column:
    """All candidates of a text by start; those that are not of the base and touch a base span are left out."""
    no = lambda x: F.lit(False)
    numbers = text.rlike("[0-9]")
    small = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
    found = [
        _found(text, F.contains(text, F.lit("@")), EMAIL, 0, lambda x: F.lit(True)),
        _found(text, numbers & text.rlike(r"[0-9]\.[0-9]"), IP, 1, lambda x: x.rlike(small)),
        _found(text, numbers & text.rlike(r"[0-9](?:[\x20-]?[0-9]){8}"), CARD, 2, lambda x: F.length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x))),
        _found(text, numbers & F.contains(text, F.lit("+")), PHONE, 3, lambda x: F.length(_digits(x)).between(8, 15)),
        _found(text, text.rlike(r"(?i)\(at\)|\[at\]"), EMAIL_SPELT, 4, no),
        _found(text, numbers & text.rlike("(?:[0-9A-Fa-f]{1,4}:){7}"), IP_SIX, 5, no),
        _found(text, numbers & text.rlike(r"[0-9]{2,3}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,4}"), PHONE_LOCAL, 6, no),
        _found(text, text.rlike(rf"(?i)(?:{SECRET_WORDS})[\x22']?[ ]{{0,3}}[=:]"), TOLD, 7, no),
        _found(text, text.rlike("AKIA|gh[pousr]_|xox[abprs]-|AIza|eyJ"), KEY, 8, no),
    ]
    # Runs of fewer than nine digits are no candidates, nor is a key that a word tells already.
    whole = F.filter(F.concat(*found), lambda c: c["base"] | (c["f"] != 2) | (F.length(_digits(c["x"])) >= 9))
    by_start = F.array_sort(whole, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["f"] < b["f"], -1).when(a["f"] > b["f"], 1).otherwise(0))

    def apart(a: Column) -> Column:
        far = (1 << 62) - 1
        ended = scan(F.transform(a, lambda c: F.when(c["base"], c["e"]).otherwise(F.lit(0)).cast("long")), 0, F.greatest)
        starts = scan(F.reverse(F.transform(a, lambda c: F.when(c["base"], c["s"]).otherwise(F.lit(far)).cast("long"))), far, F.least)
        # A base span that starts no later may reach in; the next one that starts may begin inside. Equal starts are in either list.
        free = F.zip_with(a, F.zip_with(ended, F.reverse(starts), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda c, z: F.when(c["base"] | ((z["x"] <= c["s"]) & (z["y"] >= c["e"])), c))
        return F.filter(free, lambda c: c.isNotNull())

    return let(by_start, lambda a: F.when(F.size(a) == F.size(F.filter(a, lambda c: c["base"])), a).otherwise(apart(a)))


def _judged(c: Column) -> Column:
    """A candidate with its votes (0 against, 1 for, 2 none) and the values of its features."""
    k, x, before, after = c["k"], c["x"], c["b"], c["a"]
    around = F.concat(before, F.lit(" "), after)
    digits = _digits(x)
    n = F.length(digits)
    by = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).when(k == 3, v[3]).otherwise(v[4])
    yes = lambda b: F.when(b, 1).otherwise(0)
    luhn = (n > 0) & F.call_function("luhn_check", digits)
    # The base rule judges matches of the base patterns; of runs with 13 to 15 digits that pass the checksum it says nothing.
    rule = F.when((c["f"] > 3) | (c["f"] == 2) & ~c["base"] & n.between(13, 15) & luhn, 2).otherwise(yes(c["base"]))
    gazetteer = by(
        yes(F.lower(x).rlike(rf"(?:\.|dot[)\]] ?)(?:{DOMAINS})$")),
        F.when(x.rlike("^" + RESERVED), 0).otherwise(2),
        yes(x.rlike(f"^(?:{ISSUER})")),
        F.when(x.rlike(r"^\+"), yes(digits.rlike(f"^(?:{COUNTRY})"))).otherwise(2),
        F.when(c["f"] == 8, 1).when(x.rlike(PLACEHOLDER), 0).otherwise(2),
    )
    context = F.when(by(*[around.rlike(FOR[name]) for name in KINDS]), 1).when(around.rlike(AGAINST), 0).otherwise(2)
    mixed = x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    shape = by(
        yes(F.length(x).between(6, 64)),
        yes(x.rlike(r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$|:")),
        F.when(x.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}$"), yes(luhn)).when((n < 13) | ~luhn, 0).otherwise(2),
        F.when(n.between(10, 13), 1).when(n.between(8, 15), 2).otherwise(0),
        F.when(mixed & (F.length(x) >= 12), 1).when(mixed | x.rlike("[^A-Za-z]"), 2).otherwise(0),
    )
    border = yes(~before.rlike(r"[A-Za-z0-9@/#_.-]$") & ~after.rlike(r"^[A-Za-z0-9@/#_=-]|^\.[0-9]"))
    size = F.least(F.floor(F.log2(F.length(x).cast("double"))), F.lit(7)).cast("int")
    last = F.lower(F.regexp_extract(before, r"([^\s\p{Punct}0-9]+)[^\p{L}]*$", 1))
    near = lambda t, at: F.when(t == "", 0).when(t.rlike(at.format(r"\s")), 1).when(t.rlike(at.format(r"[\x22'()<>\[\]]")), 2).otherwise(3)
    return F.struct(
        k.alias("k"), c["s"].cast("int").alias("s"), c["e"].cast("int").alias("e"), c["base"].alias("base"), F.array(rule, gazetteer, context, shape, border).alias("v"),
        c["f"].alias("f"), size.alias("size"), yes(luhn).alias("luhn"), F.pmod(F.xxhash64(last), F.lit(WORDS)).cast("int").alias("prev"), near(before, "{}$").alias("bc"), near(after, "^{}").alias("ac"),
    )


def reliabilities(counts: dict[tuple, int], rounds: int = 50) -> tuple[list, dict[tuple, float]]:
    """Expectation-maximisation over (form, votes) counts: for each kind each labeler's chance to vote rightly for either
    class, and each pattern's chance to be personal data. A vote of 2 is none.

    Every form has a share of its own, of at most a half: no form is personal data before a labeler speaks for it.
    """
    right = [[[0.8, 0.8] for _ in LABELERS] for _ in KINDS]
    share = [0.5] * len(FORM_KINDS)
    chance: dict[tuple, float] = {}
    for _ in range(rounds):
        for form, votes in counts:
            a, b = math.log(share[form]), math.log(1 - share[form])
            for (no, yes), v in zip(right[FORM_KINDS[form]], votes, strict=True):
                if v != 2:
                    a += math.log(yes if v else 1 - yes)
                    b += math.log(1 - no if v else no)
            chance[(form, votes)] = 1 / (1 + math.exp(max(-700, min(700, b - a))))
        for form in range(len(FORM_KINDS)):
            mine = [(c, chance[key]) for key, c in counts.items() if key[0] == form]
            share[form] = min(0.5, (sum(c * p for c, p in mine) + 1) / (sum(c for c, _ in mine) + 2))
        for k in range(len(KINDS)):
            for i in range(len(LABELERS)):
                for y in (0, 1):
                    told = [(c * (p if y else 1 - p), key[1][i]) for key, c in counts.items() for p in (chance[key],) if FORM_KINDS[key[0]] == k and key[1][i] != 2]
                    good, total = sum(c for c, v in told if v == y), sum(c for c, _ in told)
                    # A labeler is taken to be better than a coin.
                    right[k][i][y] = min(0.99, max(0.51, (good + 4) / (total + 5)))
    return right, chance


def fit(rows: list[tuple], rounds: int = 25) -> np.ndarray:
    """Weights of a logistic classifier by Newton's method. rows: (values of the features, count, sum of soft labels)."""
    w = np.zeros(sum(FEATURES.values()))
    at = np.cumsum([0, *FEATURES.values()])[:-1]
    x = np.zeros((len(rows), len(w)))
    for i, (values, _, _) in enumerate(rows):
        x[i, at + np.array(values)] = 1
    n, y = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    scale = min(1.0, 1e5 / max(1.0, n.sum()))
    n, y = n * scale, y * scale
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * p - y) + 0.01 * w
        h = (x.T * (n * p * (1 - p))) @ x + 0.01 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def _logit(c: Column, w: np.ndarray) -> Column:
    at = 0
    total = F.lit(0.0)
    for name, n in FEATURES.items():
        total = total + F.get(F.array(*[F.lit(float(a)) for a in w[at : at + n]]), c[name])
        at += n
    return total


def find_pii(df: DataFrame, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with base_spans and all_spans: arrays of (k, s, e), kind by number, start and end in code points, sorted.

    Candidates beyond the base are added where both the labelers' votes and the classifier give at least ``threshold``;
    they overlap no base span.
    Texts are searched once: candidates lie in a table with the rows. Null and empty texts have no spans; very long
    texts are searched whole, in time that follows their length and matches. Rows are judged one by one given the learnt
    weights, so repeated rows get the same spans, and there are no ties: spans of one start go by kind. An empty table
    learns nothing and gives none. Columns of these two names are replaced, others stay.
    """
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    judged = boxed(df, *OWN).select("_row", text.alias("_text")).select("_row", _candidates(F.col("_text")).alias("_c"))
    judged = written(judged.select("_row", F.transform("_c", _judged).alias("_c")), "private-candidates")
    each = judged.select(F.explode("_c").alias("c"))
    counts = {(r["f"], tuple(r["v"])): r["count"] for r in each.groupBy("c.f", "c.v").count().collect()}  # at most 9 * 3**5
    _, chance = reliabilities(counts)
    told = F.create_map(*[F.lit(x) for (f, v), p in sorted(chance.items()) for x in (f"{f}:{','.join(map(str, v))}", float(p))]) if chance else F.lit(None).cast("map<string,double>")
    votes = lambda c: F.concat(c["f"].cast("string"), F.lit(":"), F.array_join(c["v"].cast("array<string>"), ","))
    label = lambda c: F.coalesce(F.try_element_at(told, votes(c)), F.lit(0.0))
    rows = each.select(*[F.col("c")[n].alias(n) for n in FEATURES], label(F.col("c")).alias("y")).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    w = fit(sorted((tuple(r[n] for n in FEATURES), r["n"], round(r["y"], 6)) for r in rows.collect()))  # at most the product of FEATURES
    least = math.log(threshold / (1 - threshold))
    span = lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))
    base = F.sort_array(F.transform(F.filter("_c", lambda c: c["base"]), span))
    every = F.sort_array(F.transform(F.filter("_c", lambda c: c["base"] | (_logit(c, w) >= least) & (label(c) >= threshold)), span))
    once = let(every, lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1))))  # two forms may find one span
    return judged.select(*[F.col("_row")[c].alias(c) for c in without(df, *OWN).columns], base.alias("base_spans"), once.alias("all_spans"))


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
