"""PII surrogates: detected entities get keyed replacements of their own type and format. DataFrame functions only.

A surrogate is drawn from SHA-512 of key, type, attempt and value, so equal values get equal surrogates in all
documents (coreference). Digits stay digits, letters stay letters of their case and script, punctuation, "+1", mail
domains and titles stay; names get an ending of the title's gender. A name is all that follows a title: up to five
words with particles, hyphens, apostrophes. Its parts are entities of their own and are replaced wherever the document
has them, with the title or without; particles and initials stay. Letters of scripts not in SCRIPTS become Latin. A collision check over all distinct values makes
values whose surrogate is another value's surrogate, or is itself found in the data, draw again, until none is left.
What still clashes after some draws, as where a format has few values, draws from a wider space: longer local parts,
names and numbers, by four more characters each round, so that it ends whatever the data hold.

Null texts stay null and empty texts empty, with no entities. Rows are independent but for the collision check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import written

# fixed values: entity patterns, tried in this order
MALE, FEMALE = r"Mr|Herr|Monsieur|Señor|Sr", r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra"
PATTERNS = {
    "email": r"[\p{L}0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"\b[0-9a-f]{32,64}\b|\bAKIA[0-9A-Z]{16}\b|\b(?:sk|ghp|pk)[-_][0-9A-Za-z]{16,}",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|\+(?=(?:[ .()-]{0,3}\d){7})\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,6}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
L = r"[\p{L}\p{M}]"
TITLES = rf"(?:(?:{MALE}|{FEMALE}|Dr|Prof)\.? )+"
PARTICLES = r"van|von|de|del|della|der|den|di|da|dos|du|la|le|el|al|bin|ibn|ter|ten|zu|zum|zur|y"
_WORD = rf"(?:(?:{PARTICLES}) )*(?:d['’]|al-)?(?:\p{{Lu}}\.(?= ?\p{{Lu}})|\p{{Lu}}(?:['’]\p{{Lu}})?{L}+(?:['’]\p{{Lu}}{L}*|-{L}+)*)"
NAME = rf"\b{TITLES}{_WORD}(?: {_WORD}){{0,4}}"
PART = rf"(?:\p{{Lu}}['’])?{L}{{2,}}(?:['’]\p{{Lu}}{L}*)*"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = "áàâäéèêëíîïñóôöúûüç"
#: Letters that stand for those of their script and case.
SCRIPTS = {
    r"(?=\p{Ll})\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"(?=\p{Lu})\p{IsGreek}": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"(?=\p{Ll})\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"(?=\p{Lu})\p{IsCyrillic}": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsHan}": "王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにのはひまみもやゆよらりる",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニノハヒマミモヤユヨラリル",
    r"\p{IsHangul}": "김이박최정강조윤장임한오서신권황안송류홍",
    r"\p{IsDevanagari}": "अकखगघचछजटठडढतथदधनपफबभमयरलवशसह",
}
#: Exceptions (values that drew again) up to this many travel as a map; beyond it the entities are joined.
MAX_MAP = 20_000
#: Each draw after those in the value's own format is so many characters longer.
STEP = 4


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return F.when(value.rlike("^[aoe]:"), F.lit("name")).otherwise(out)


def _real(value: Column) -> Column:
    """What stands in the text; parts of names carry their ending before a colon."""
    return F.when(value.rlike("^[aoe]:"), F.substr(value, F.lit(3))).otherwise(value)


def _detected(df: DataFrame, text: Column) -> DataFrame:
    """df with __pat, the pattern of a row's entities, and __e, the entities themselves."""

    def ending(n: Column) -> Column:
        return F.when(n.rlike(rf"\b(?:{MALE})\.? "), "o").when(n.rlike(rf"\b(?:{FEMALE})\.? "), "a").otherwise("e")

    def parts(n: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.regexp_replace(n, f"^{TITLES}", ""), F.lit(PART), F.lit(0)), lambda p: ~p.rlike(f"^(?:{PARTICLES})$"))
        return F.transform(words, lambda p: F.struct(p.alias("p"), ending(n).alias("e")))

    def valued(m: Column) -> Column:
        same = F.filter("__p", lambda x: x["p"] == m)
        end = F.when(F.exists(same, lambda x: x["e"] == "o"), "o").when(F.exists(same, lambda x: x["e"] == "a"), "a").otherwise("e")
        return F.when(F.size(same) > 0, F.concat(end, F.lit(":"), m)).otherwise(m)

    marked = df.withColumn("__p", F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), parts)))
    known = F.array_join(F.array_distinct(F.transform("__p", lambda x: x["p"])), "|")
    pattern = F.when(F.size("__p") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{M}\p{N}])(?:"), known, F.lit(r")(?![\p{L}\p{M}\p{N}])"))).otherwise(ANY)
    every = F.regexp_extract_all(text, F.col("__pat"), F.lit(0))
    return marked.withColumn("__pat", pattern).withColumn("__e", F.when(F.size("__p") > 0, F.transform(every, valued)).otherwise(every))


def _draw(digest: Column, i: Column, n: int) -> Column:
    """A number below n from the i-th pair of hex digits."""
    return F.pmod(F.conv(F.substr(digest, F.pmod(i * 3, F.lit(125)) + 1, F.lit(3)), 16, 10).cast("int"), F.lit(n))


def _reshape(value: Column, digest: Column) -> Column:
    """Characters are redrawn inside their class."""

    def one(c: Column, i: Column) -> Column:
        def of(chars: str) -> Column:
            return F.substr(F.lit(chars), _draw(digest, i, len(chars)) + 1, F.lit(1))

        return (
            F.when(c.rlike("[0-9]"), F.when(i == 0, of("123456789")).otherwise(of("0123456789")))
            .when(c.rlike("[a-z]"), of(LOWER))
            .when(c.rlike("[A-Z]"), of(UPPER))
            .when(~c.rlike(r"\p{L}"), c)
            .otherwise(reduce(lambda out, x: F.when(c.rlike(x[0]), of(x[1])).otherwise(out), SCRIPTS.items(), latin(c, of)))
        )

    def latin(c: Column, of) -> Column:
        return F.when(c.rlike(r"\p{Ll}"), of(ACCENTED)).when(c.rlike(r"\p{Lu}"), F.upper(of(ACCENTED))).otherwise(of(LOWER))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def surrogate(value: Column, key: str, attempt: Column, draws: int = 8) -> Column:
    kind = kind_of(value)
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), _real(value)), 512)
    wider = F.greatest(attempt - (draws - 1), F.lit(0)) * STEP
    more = F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("wider"), attempt.cast("string"), value), 512), F.lit(1), wider)
    letters, digits = F.translate(more, "0123456789", "ghijklmnop"), F.translate(more, "abcdef", "012345")
    at = F.instr(value, "@")
    local = F.substr(value, F.lit(1), at - 1)
    # a local part of punctuation only has nothing to redraw
    bare = F.when(local.rlike(r"[\p{L}0-9]"), "").otherwise(F.translate(F.substr(digest, F.lit(1), F.lit(2 * STEP)), "0123456789", "ghijklmnop"))
    email = F.concat(_reshape(local, digest), bare, letters, F.substr(value, at))
    hexes = F.concat(F.substr(digest, F.lit(1), F.length(value)), more)
    octets = F.concat_ws(".", *((_draw(digest, F.lit(j), 223) + 1).cast("string") for j in range(4)))
    # all addresses have four numbers; a port makes room
    octets = F.when(wider > 0, F.concat(octets, F.lit(":"), digits)).otherwise(octets)
    prefix = F.regexp_extract(value, r"^(?:\+1(?=\D)|\+\d{1,3}(?=\D)|[A-Z]{2}(?=\d\d)|AKIA|(?:sk|ghp|pk)[-_])?", 0)
    rest = F.concat(prefix, _reshape(F.substr(value, F.length(prefix) + 1), digest), digits)
    end = F.substr(value, F.lit(1), F.lit(1))
    # endings in the script of the name; letters without case have none
    end = F.when(value.rlike(r"\p{IsCyrillic}$"), F.translate(end, "aoe", "аое")).when(value.rlike(r"\p{IsGreek}$"), F.translate(end, "aoe", "αοε")).when(value.rlike(r"\p{Lo}$"), "").otherwise(end)
    name = F.concat(_reshape(_real(value), digest), letters, end)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(value.rlike("^[0-9a-f]{32,64}$"), hexes)
        .when(kind == "name", name)
        .otherwise(rest)
    )


def _clashing(drawn: DataFrame) -> DataFrame:
    """Values whose surrogate another value also claims; a value found in the data claims itself."""
    claims = drawn.select(F.col("s").alias("claim"), "value").union(drawn.select(_real(F.col("value")).alias("claim"), "value"))
    many = claims.groupBy("claim").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo != hi")
    # on a clash of two surrogates the smaller value keeps its own, unless the claim is itself a value
    back = drawn.join(many, drawn["s"] == many["claim"])
    taken = back.join(drawn.select(_real(F.col("value")).alias("real")).distinct(), F.col("claim") == F.col("real"), "left")
    same = drawn.where(F.col("s") == _real(F.col("value"))).select("value")
    return taken.where("value != lo or real is not null").select("value").union(same).distinct()


def replace(df: DataFrame, key: str, text_col: str = "text", draws: int = 8) -> DataFrame:
    """df with surrogates in its text, and n_entities."""
    names = [c for c in df.columns if c != text_col]
    found = _detected(df, F.col(text_col).cast("string"))
    text = F.col(text_col).cast("string")
    values = found.select(F.explode("__e").alias("value")).distinct()
    drawn = written(values.select("value", F.lit(0).alias("attempt"), surrogate(F.col("value"), key, F.lit(0), draws).alias("s")), "surrogates")
    while (again := written(_clashing(drawn), "clashes")).limit(1).count():
        marked = drawn.join(again.withColumn("hit", F.lit(1)), "value", "left").withColumn("attempt", F.col("attempt") + F.coalesce("hit", F.lit(0)))
        drawn = written(marked.select("value", "attempt", surrogate(F.col("value"), key, F.col("attempt"), draws).alias("s")), "surrogates")
    redrawn = drawn.where("attempt > 0").select("value", "attempt")
    parts = F.split(text, F.col("__pat"), -1)

    def joined(fill: Column) -> Column:
        return F.array_join(F.transform(parts, lambda g, i: F.concat(g, F.coalesce(F.get(fill, i), F.lit("")))), "")

    few = redrawn.limit(MAX_MAP + 1).count()
    if few <= MAX_MAP:
        if few:
            lookup = redrawn.agg(F.map_from_entries(F.collect_list(F.struct("value", "attempt"))).alias("m")).scalar()
            done = found.withColumn("__m", lookup).withColumn("__s", F.transform("__e", lambda v: surrogate(v, key, F.coalesce(F.try_element_at("__m", v), F.lit(0)), draws)))
        else:
            done = found.withColumn("__s", F.transform("__e", lambda v: surrogate(v, key, F.lit(0), draws)))
    else:
        rows = found.withColumn("__r", F.monotonically_increasing_id())
        each = rows.select("__r", F.posexplode("__e").alias("i", "value")).join(redrawn, "value", "left")
        made = each.groupBy("__r").agg(F.array_sort(F.collect_list(F.struct("i", surrogate(F.col("value"), key, F.coalesce("attempt", F.lit(0)), draws).alias("s")))).alias("x"))
        done = rows.join(made, "__r", "left").withColumn("__s", F.coalesce(F.col("x.s"), F.array().cast("array<string>")))
    new = F.when(F.size("__e") > 0, joined(F.col("__s"))).otherwise(text)
    return done.select(*names, new.alias(text_col), F.greatest(F.size("__e"), F.lit(0)).cast("long").alias("n_entities"))
