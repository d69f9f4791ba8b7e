"""Person names as column expressions: cleaning, parsing, surname normalisation, aliases.

Everything stays in the JVM, but for canonical composition, for which there is no built-in function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A first name, and the names that are read as it. Where a name stands in several rows the first row
# wins, except that the name in front of a colon always stands for itself.
ALIASES = """
richard: rich rick ricky dick dickie
robert: rob robbie bob bobby bert
william: will willy bill billy liam
thomas: tom tommy
james: jim jimmy jamie
john: jon johnny jack
joseph: joe joey
michael: mike mikey mick mickey
david: dave davey
daniel: dan danny
matthew: matt matty
anthony: tony ant
edward: ed eddie ted teddy ned
charles: charlie chuck chas
christopher: chris kit
nicholas: nick nicky
patrick: pat paddy
timothy: tim timmy
stephen: steve stevie steven
benjamin: ben benny
alexander: alex al xander
andrew: andy drew
jonathan: jon jonny nathan
samuel: sam sammy
joshua: josh
nathaniel: nate nathan nat
zachary: zach zack
gregory: greg
raymond: ray
lawrence: larry laurie
kenneth: ken kenny
ronald: ron ronnie
donald: don donnie
gerald: gerry jerry
douglas: doug
phillip: phil
frederick: fred freddy freddie
elizabeth: liz lizzy beth betty eliza
catherine: cathy kate katie cat katherine kathryn
jennifer: jen jenny
margaret: maggie meg peggy marge
patricia: pat patty trish
deborah: deb debbie
stephanie: steph
victoria: vicky tori
alexandra: alex lexi
rebecca: becca becky
jessica: jess jessie
christina: chris tina christine
stacy: stacey anastasia
sergei: sergey serge
muhammad: mohammed mohamed mohammad
vladimir: vlad
dmitri: dmitry dimitri
yuri: yury
nikolai: nikolay nickolai
aleksei: alexei alexey aleksey
evgeni: evgeny yevgeni yevgeny
marc: mark marcus
denis: dennis
michel: michael mike
pierre: peter pete
jacques: jack james
jean: john
francois: francis frank
guillaume: william will bill
louis: lewis
henri: henry
andre: andrew andy
philippe: phillip phil
rene: renee
claude: claud
luc: luke lucas
etienne: stephen steve steven
benoit: benedict ben
mathieu: matthew matt
sebastien: sebastian
nicolas: nicholas nick
olivier: oliver
maxime: max maximilian
antoine: anthony tony
gabriel: gabe
raphael: ralph
dominique: dominic dom
yves: ives
alain: alan allan allen
gaetan: guy
rejean: ray
normand: norman norm
"""

# What ends a name without being part of it, what may stand in front of a surname, and what may follow that.
SUFFIX = r"\s+(\(?jr\)?|\(?sr\)?|ii|iii|iv|2nd|3rd)\.?$"
INNER_SUFFIX = r"\s*\((?:jr|sr|ii|iii|iv)\)\s*"
PARTICLE = "van|von|de|du|le|la|del|della|di|el|al"
ARTICLE = "der|den|het|la|les"
POSITION = r"\s*\([A-Za-z/]+\)\s*$"
QUOTES = "’‘ʼ`"

BLANK = r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$"
#: Texts that may not be composed.
UNCOMPOSED = r"[^\x00-\x{2FF}]"
#: Letters that have no decomposition.
SPECIAL_ONE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T"}
SPECIAL_MORE = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "þ": "th", "Þ": "TH"}


def fold_table() -> tuple[str, str]:
    """(from, to) of translate(): accented Latin letters to their base letters; combining marks go."""
    one = dict(SPECIAL_ONE)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            one[chr(code)] = base[0]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(one) + marks, "".join(one.values())


def alias_table(text: str = ALIASES) -> dict[str, str]:
    """Every name that is read as another, or as itself, with that name."""
    out: dict[str, str] = {}
    for line in text.strip().splitlines():
        name, others = line.split(":")
        out[name] = name
        for other in others.split():
            out.setdefault(other, name)
    return out


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def composed(c: Column) -> Column:
    """Canonical composition: letters and the marks after them as one letter where there is one.

    Python composes what holds letters from U+0300 on, in Arrow batches; everything else is composed already and stays in the
    JVM.
    """

    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    odd = c.rlike(UNCOMPOSED)
    return F.when(odd, F.pandas_udf(compose, "string")(F.when(odd, c))).otherwise(c)


def preprocess(c: Column) -> Column:
    """Composed letters, plain apostrophes, no position in parentheses at the end, single spaces."""
    c = F.translate(composed(c), QUOTES, "'" * len(QUOTES))
    return F.regexp_replace(trimmed(F.regexp_replace(c, POSITION, "")), r"\s+", " ")


def fold(c: Column) -> Column:
    for letter, plain in SPECIAL_MORE.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return F.translate(c, *fold_table())


def ordered(c: Column) -> Column:
    """A cleaned name in lower case, without suffixes, first name first."""
    c = F.regexp_replace(F.lower(preprocess(c)), SUFFIX, "")
    c = trimmed(F.regexp_replace(c, INNER_SUFFIX, " "))
    at = F.instr(c, ",")
    return F.when(at > 0, F.concat(trimmed(F.substr(c, at + 1)), F.lit(" "), trimmed(F.substr(c, F.lit(1), at - 1)))).otherwise(c)


def apart(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a further column that is computed once, however often it is used: the optimizer does not merge it into those uses.

    Large expressions that are merged outgrow the limit of compiled methods.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_names(df: DataFrame, title: str) -> DataFrame:
    """df with first, last, middle; a single word is a first name, and a null no name at all."""
    df = apart(df, "__ordered", ordered(F.coalesce(F.col(f"`{title}`"), F.lit(""))))
    df = apart(df, "__parts", F.split(F.lower(fold(F.col("__ordered"))), " "))
    parts, many = F.col("__parts"), F.size("__parts") > 1
    return df.select(
        "*",
        parts[0].alias("first"),
        F.when(many, F.element_at(parts, -1)).otherwise("").alias("last"),
        F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.size(parts) - 2), " ")).otherwise("").alias("middle"),
    ).drop("__ordered", "__parts")


def norm_surname(c: Column) -> Column:
    c = F.replace(c, F.lit("'"), F.lit(""))
    c = F.when(c.startswith("mac") & (F.octet_length(c) > 4), F.concat(F.lit("mc"), F.substr(c, F.lit(4)))).otherwise(c)
    c = F.regexp_replace(c, rf"^({PARTICLE})\s+", "")
    c = F.regexp_replace(c, rf"^({PARTICLE})({ARTICLE})\s*", "")
    return F.replace(c, F.lit(" "), F.lit(""))


def alias_map(aliases: dict[str, str] | None = None) -> Column:
    return F.create_map(*[F.lit(x) for pair in (aliases or alias_table()).items() for x in pair])


def canonical(c: Column, aliases: dict[str, str] | None = None) -> Column:
    return F.coalesce(alias_map(aliases)[c], c)


def variants(first: Column) -> Column:
    """The first name, and if it is hyphenated, spaced, joined and its first part."""
    return F.when(first.contains("-"), F.array_distinct(F.array(first, F.replace(first, F.lit("-"), F.lit(" ")), F.replace(first, F.lit("-"), F.lit("")), F.substring_index(first, "-", 1)))).otherwise(F.array(first))


def in_bytes(c: Column) -> Column:
    """The string of which each character is a byte of c: lengths and distances then count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def typo(a: Column, b: Column) -> Column:
    """One or two byte edits apart, by length."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    distance = F.levenshtein(in_bytes(a), in_bytes(b))
    return (longest >= 4) & (distance > 0) & (distance <= F.when(longest >= 6, 2).otherwise(1))


def initial(first: Column) -> Column:
    short = (F.octet_length(first) <= 2) & first.endswith(".")
    return F.when(short, F.regexp_replace(first, r"\.+$", "")).when(F.octet_length(first) == 1, first).otherwise("")


def deletions(s: Column) -> Column:
    """s, and what one deletion (from four bytes) or two (from six) leave of it: strings that are a typo() apart share one.

    s: a column of in_bytes().
    """
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    one, n = less(s), F.length(s)
    return F.when(n >= 6, F.array_distinct(F.concat(F.array(s), one, F.flatten(F.transform(one, less))))).when(n >= 4, F.array_distinct(F.concat(F.array(s), one))).otherwise(F.array(s))
