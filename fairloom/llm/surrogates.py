"""Surrogates for personal data: every detected entity gets a keyed, type-consistent replacement.

Detection is one pass of one pattern. A surrogate is made from a keyed hash of the entity's normal form: digits stay
digits and letters stay letters of the same script and case, punctuation and length stay, a card number that passed
its check digit passes it again, addresses stay addresses, people keep their title and get given names of the same
gender and script. The same entity gets the same surrogate everywhere, however it is written (coreference); two names
that share a surname share its surrogate. Different entities get different surrogates, and no surrogate is an entity
of the corpus: surrogates are checked in rounds, what collides is hashed again with the next round's number. Where a
space is full (short names, mailboxes and phone numbers), surrogates grow every few rounds, past the entity's length.

All of it is DataFrame operations. Only distinct entities are shuffled for the check; texts are shuffled only for
documents that hold an entity. Without the secret key surrogates can't be traced back.

Defined results: null and empty texts stay as they are. Null ids and repeated rows are handled like others. Columns
stay as they were, whatever their names, but for the text, n_entities, and n_chars where there is one. An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairloom.llm.common import unused, without
from fairloom.operators.storage import cut, written

#: For tests and demonstrations; give your own.
KEY = "change-me"
ROUNDS = 60
#: After so many rounds without a free value surrogates grow by a syllable, letter or digit, and again after as many.
GROW = 4

# Fixed patterns, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = {"female": r"Mrs|Ms|Miss|Frau|Mme|Sra|Señora|Г-жа", "male": r"Mr|Herr|Sr|Señor|Г-н"}
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "card": r"(?<![\w.])[3-6](?:[ -]?\d){12,18}(?!\w)",
    "female": rf"(?<![\p{{L}}\d])(?:{_TITLES['female']})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
    "male": rf"(?<![\p{{L}}\d])(?:{_TITLES['male']})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
PATTERN = "|".join(KINDS.values())
#: Every entity has a digit, an @ or a title; most texts have none, and these two are found much faster than PATTERN.
NEEDED = (r"[0-9@]", r"(?:M(?:rs?|s|iss|me)|Frau|Herr|S(?:ra?|eñora?)|Г-)")
_SYLLABLES = {
    "latin": "ba be bo da de do ka ke la le lo ma me mi na ne ni no ra re ri ro sa se si ta te ti to va ve vi".split(),
    "cyrillic": "ба бе бо да де до ка ке ла ле ло ма ме ми на не ни но ра ре ри ро са се си та те ти то ва ве ви".split(),
}
_ENDINGS = {("female", "latin"): "a", ("male", "latin"): "n", ("female", "cyrillic"): "а", ("male", "cyrillic"): "н"}
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя")


def kind_of(match: Column) -> Column:
    """The first pattern that a whole match fits."""
    fits = [(k, match.rlike(f"^(?:{p})$")) for k, p in KINDS.items()]
    return reduce(lambda rest, x: F.when(x[1], x[0]).otherwise(rest), reversed(fits[:-1]), F.lit(fits[-1][0]))


def _number(stream: Column, i: Column | int, below: int) -> Column:
    """A number under below from the stream's i-th four hex digits (of 32, over and over)."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32 * 4 + 1
    return F.conv(F.substring(stream, at, F.lit(4)), 16, 10).cast("int") % below


def _stream(key: str, *what: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lit(key), *what), 512)


def _masked(value: Column, stream: Column) -> Column:
    """Every digit and lower-case letter replaced by another of its alphabet, the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for alphabet in _ALPHABETS:
            size = len(alphabet)
            place = F.instr(F.lit(alphabet), c)
            moved = (place - 1 + _number(stream, i, size)) % size + 1
            out = F.when(place > 0, F.substring(F.lit(alphabet), moved, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits, from the right, the last one counted once."""
    each = F.reverse(F.split(digits, ""))

    def weighed(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(each, weighed), F.lit(0), lambda a, x: a + x) % 10


def _name(stream: Column, gender: str, script: str, given: bool, more: int) -> Column:
    syllables = F.array(*[F.lit(s) for s in _SYLLABLES[script]])
    parts = [F.get(syllables, _number(stream, i, 32)) for i in range((3 if given else 5) + more)]
    return F.concat(*parts, F.lit(_ENDINGS[gender, script] if given else ""))


def surrogate(kind: Column, norm: Column, key: str, attempt: int) -> Column:
    """The attempt-th surrogate of an entity's normal form."""
    stream = _stream(key, kind, norm, F.lit(str(attempt)))
    more = attempt // GROW
    added = _stream(key, F.lit("added"), kind, norm, F.lit(str(attempt)))
    letters, digits = (F.concat(F.lit(""), *[F.substring(F.lit(x), _number(added, i, len(x)) + 1, F.lit(1)) for i in range(more)]) for x in (_ALPHABETS[1], _ALPHABETS[0]))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    label = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(top) - 1)
    email = F.concat(F.substring(_masked(local, stream), 1, 64 - more), letters, F.lit("@"), _masked(label, _stream(key, F.lit("domain"), label)), F.lit("."), top)
    ip = F.concat_ws(".", *[(_number(stream, i, 254) + 1).cast("string") for i in range(4)])
    body = F.concat(F.substring(norm, F.lit(1), F.lit(1)), _masked(F.substring(norm, F.lit(2), F.char_length(norm) - 2), stream))
    check = F.concat(body, F.lit("0"))
    valid = F.concat(body, ((10 - _luhn(check)) % 10).cast("string"))
    loose = F.concat(body, _masked(F.substring(norm, F.char_length(norm), F.lit(1)), _stream(key, F.lit("last"), norm, F.lit(str(attempt)))))
    card = F.when(_luhn(norm) == 0, valid).otherwise(loose)
    country = F.substring_index(norm, "/", 1)
    phone = F.concat(country, F.lit("/"), _masked(F.substring_index(norm, "/", -1), stream), digits)
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
    for script in _SYLLABLES:
        own = norm.rlike(r"^\p{IsCyrillic}") if script == "cyrillic" else ~norm.rlike(r"^\p{IsCyrillic}")
        out = out.when((kind == "surname") & own, _name(stream, "male", script, given=False, more=more))
        for gender in ("female", "male"):
            out = out.when((kind == f"given_{gender}") & own, _name(stream, gender, script, given=True, more=more))
    return out.otherwise(_masked(norm, stream))


def _parts(match: Column, kind: Column) -> Column:
    """A match's parts as an array of (kind, raw): one, or a title (kept) and names."""
    words = F.split(match, " ")
    named = F.transform(words, lambda w, i: F.struct(
        F.when(i == 0, "keep").when(i == F.size(words) - 1, "surname").otherwise(F.concat(F.lit("given_"), kind)).alias("kind"), w.alias("raw"),
    ))
    return F.when(kind.isin("female", "male"), named).otherwise(F.array(F.struct(kind.alias("kind"), match.alias("raw"))))


def _normal(kind: Column, raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"\D", "")
    country = F.when(raw.startswith("+"), F.regexp_extract(raw, r"^\+(\d{1,3})[ .(-]", 1)).otherwise("")
    phone = F.concat(country, F.lit("/"), F.substring(digits, F.char_length(country) + 1, F.char_length(digits)))
    return F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", phone).when(kind == "ip", raw).otherwise(F.lower(raw))


def _laid_out(kind: Column, raw: Column, value: Column) -> Column:
    """A surrogate in the way its entity is written here: punctuation and capitals."""
    digits = F.regexp_replace(value, r"\D", "")

    def step(state: Column, c: Column) -> Column:
        is_digit = c.rlike(r"^\d$")
        put = F.when(is_digit, F.substring(digits, state["k"], F.lit(1))).otherwise(c)
        return F.struct((state["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"), F.concat(state["out"], put).alias("out"))

    spaced = F.aggregate(F.split(raw, ""), F.struct(F.lit(1).alias("k"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(digits, s["k"], F.char_length(digits))))

    def like(value: Column, raw: Column) -> Column:
        return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.substring(raw, i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")

    cased = F.concat_ws("@", *[like(F.substring_index(value, "@", n), F.substring_index(raw, "@", n)) for n in (1, -1)])
    return F.when(kind == "keep", raw).when(kind.isin("card", "ssn", "phone"), spaced).when(kind == "ip", value).when(kind == "email", cased).otherwise(F.initcap(value))


def assign(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """kind, norm, value: different for different entities of a kind, and never an entity itself.

    What has no surrogate of its own after all rounds (all addresses there are being in use, say) gets a keyed
    placeholder without its kind's format: kind and 32 hex digits.
    """
    entities = cut(entities.select("kind", "norm").distinct())
    real = entities.select("kind", F.col("norm").alias("value"))
    pending, settled = entities, entities.select("kind", "norm", F.col("norm").alias("value")).limit(0)
    for attempt in range(rounds):
        tried = pending.withColumn("value", surrogate(F.col("kind"), F.col("norm"), key, attempt))
        free = tried.join(real.union(settled.select("kind", "value")), ["kind", "value"], "left_anti")
        won = cut(free.groupBy("kind", "value").agg(F.min("norm").alias("norm")).select("kind", "norm", "value"))
        settled = settled.unionByName(won)
        pending = cut(pending.join(won, ["kind", "norm"], "left_anti"))
        if pending.isEmpty():
            return settled
    digits = F.substring(_stream(key, F.lit("placeholder"), F.col("kind"), F.col("norm")), 1, 32)
    return settled.unionByName(pending.withColumn("value", F.concat("kind", F.lit("-"), digits)))


def pseudonymised(docs: DataFrame, secret: str = KEY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with surrogates in the text, and n_entities.

    PATTERN goes over the corpus once, and again over the texts that hold an entity; in between, rows and what was
    found in them are a table in the shared folder.
    """
    base = without(docs, "n_entities")
    kept = [F.col(f"`{c}`") for c in base.columns]
    matches, hashed, k, h, words = (unused(c, *docs.columns) for c in ("matches_", "hash_", "k_", "h_", "words_"))
    body = F.col(text)
    entities = F.when(body.rlike(NEEDED[0]) | body.rlike(NEEDED[1]), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    found = written(base.withColumns({matches: F.coalesce(entities, F.array().cast("array<string>")), hashed: F.xxhash64(text)}))
    clean, holding = found.where(F.size(matches) == 0), found.where(F.size(matches) > 0)
    each = holding.select(F.col(key).alias("k"), F.col(hashed).alias("h"), F.posexplode(matches).alias("i", "match")).withColumn("of", kind_of(F.col("match")))
    each = each.select("k", "h", "i", F.posexplode(_parts(F.col("match"), F.col("of"))).alias("j", "part")).select("k", "h", "i", "j", F.col("part.kind").alias("kind"), F.col("part.raw").alias("raw"))
    each = cut(each.withColumn("norm", _normal(F.col("kind"), F.col("raw"))).distinct())
    values = assign(each.where("kind <> 'keep'"), secret)
    put = each.join(values, ["kind", "norm"], "left").withColumn("put", _laid_out(F.col("kind"), F.col("raw"), F.col("value")))
    ordered = lambda place, what: F.transform(F.array_sort(F.collect_list(F.struct(place, what))), lambda x: x[what])
    whole = put.groupBy("k", "h", "i").agg(F.array_join(ordered("j", "put"), " ").alias("word"))
    lists = whole.groupBy(F.col("k").alias(k), F.col("h").alias(h)).agg(ordered("i", "word").alias(words))
    joined = holding.join(lists.hint("shuffle_hash"), holding[key].eqNullSafe(lists[k]) & (holding[hashed] == lists[h]))
    # a text is its gaps and the new words in turn; the last gap has no word behind it
    pairs = F.arrays_zip(F.split(body, PATTERN, -1).alias("g"), F.col(words).alias("w"))
    new = F.array_join(F.transform(pairs, lambda z: F.concat(z["g"], F.coalesce(z["w"], F.lit("")))), "")
    changed = joined.withColumn(text, new)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return clean.select(*kept, F.lit(0).cast("long").alias("n_entities")).unionByName(changed.select(*kept, F.size(matches).cast("long").alias("n_entities")))
