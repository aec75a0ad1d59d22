"""Amounts and dates as people say or dictate them in Italian ("ventitre euro e quaranta", "sabato scorso"), read and spelled out as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import MONEY

#: Number words, euro and cent words, connectives, how a written amount looks.
UNITS = ["zero", "uno", "due", "tre", "quattro", "cinque", "sei", "sette", "otto", "nove"]
TEENS = ["dieci", "undici", "dodici", "tredici", "quattordici", "quindici", "sedici", "diciassette", "diciotto", "diciannove"]
TENS = ["venti", "trenta", "quaranta", "cinquanta", "sessanta", "settanta", "ottanta", "novanta"]
EURO, CENT, POINT = ("euro", "eur", "euri"), ("centesimi", "centesimo", "cent"), ("virgola", "punto")
WRITTEN = r"\d{1,3}(?:\.\d{3})+,\d{1,2}|\d+[.,]\d{1,2}(?!\d)"
#: Months, weekdays from Monday on, ordinals of days, words for today and yesterday, how dates look.
MONTH_NAMES = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]
MONTH_SHORT = ["gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic"]
WEEKDAYS = ["lunedi", "martedi", "mercoledi", "giovedi", "venerdi", "sabato", "domenica"]
ORDINALS = ["primo", "secondo", "terzo", "quarto", "quinto", "sesto", "settimo", "ottavo", "nono", "decimo"]
TODAY = ["oggi", "stamattina", "stamani", "stasera", "today", "aujourd hui", "heute", "hoy"]
YESTERDAY = ["ieri", "yesterday", "hier", "gestern", "ayer"]
DAY_BEFORE = r"l\s+altro\s+ieri|altro\s*ieri|avantieri|ieri\s+l\s+altro"
ARTICLE, DAY = r"(?:il|del|al|lo|l)\s+", r"(\d{1,2}|[a-z]+)"
DATE_WRITTEN = r"\b\d{1,2}(?:[/-]\d{1,2}(?:[/-]\d{2,4})?|\.\d{1,2}\.\d{2,4})\b"
DATE_MONTH = rf"\b(?:{ARTICLE})?{DAY}\s+(?:di\s+)?({'|'.join(MONTH_NAMES + MONTH_SHORT)})\b(?:\s+(\d{{4}}))?"
DATE_RELATIVE = rf"\b(?:{DAY_BEFORE}|{'|'.join(YESTERDAY + TODAY)})\b"
DATE_WEEKDAY = rf"\b({'|'.join(WEEKDAYS)})(\s+scors[oa])?\b"
DATE_DAY = rf"\b(?:{ARTICLE}{DAY}(?:\s+del\s+mese)?|{DAY}\s+del\s+mese)\b"
#: Words that say nothing about a category.
STOP = (
    "il lo la i gli le un uno una di da in con su per tra fra a al allo alla ai agli alle del dello della dei degli delle dal dalla nel nella sul sulla "
    "e o ed che quella quello questa questo mi ho ha era categoria l d"
).split()


def _said() -> list[str]:
    """The words of 0 to 99; a unit that opens with a vowel takes the place of the ten's last one."""
    return UNITS + TEENS + [(t[:-1] if u[:1] in ("u", "o") else t) + u for t in TENS for u in ["", *UNITS[1:]]]


def _map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _folded(text: Column) -> Column:
    return F.translate(F.lower(text), "àáèéìíòóùú", "aaeeiioouu")


def _hundreds(word: Column) -> Column:
    """Value of a word below 1,000, or null."""
    small = _map({w: n for n, w in enumerate(_said())} | {t + u: 20 + 10 * i + n for i, t in enumerate(TENS) for n, u in enumerate(UNITS) if n})
    at = F.locate("cento", word)
    head, rest = F.substring(word, F.lit(1), at - 1), F.substring(word, at + 5, F.length(word))
    count = F.when(head == "", 1).otherwise(_map({u: n for n, u in enumerate(UNITS) if n > 1})[head])
    tail = F.when(rest == "", 0).otherwise(F.coalesce(small[rest], small[F.concat(F.lit("o"), rest)]))
    return F.when(at == 0, small[word]).otherwise(count * 100 + tail)


def number(word: Column) -> Column:
    """Value of digits, or of an Italian number written as one lower-case word below a million; else null."""
    at = F.locate("mila", word)
    head, rest = _hundreds(F.substring(word, F.lit(1), at - 1)), F.substring(word, at + 4, F.length(word))
    after = F.substring(word, 6, 1 << 30)
    thousand = 1000 + F.when(after == "", 0).otherwise(_hundreds(after))
    thousands = F.when(head > 1, head * 1000 + F.when(rest == "", 0).otherwise(_hundreds(rest)))
    value = F.when(F.startswith(word, F.lit("mille")), thousand).when(at > 0, thousands).otherwise(_hundreds(word))
    return F.when(word.rlike("^[0-9]+$"), word.try_cast("bigint")).otherwise(value.cast("bigint"))


def plain(text: Column) -> Column:
    """Lower case without accents and apostrophes, the euro sign as a word."""
    return F.regexp_replace(F.replace(_folded(text), F.lit("€"), F.lit(" euro ")), "['`\u2019]", " ")


def content(text: Column, numbers: bool = False) -> Column:
    """The words of a text without stop words, and without numbers unless ``numbers``; empty for null."""
    found = F.regexp_extract_all(plain(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP) & (F.lit(numbers) | w.rlike("[a-z]")))


def stem(word: Column) -> Column:
    """Singular and plural, masculine and feminine as one: words of four letters and more lose a last vowel (not u)."""
    return F.when((F.length(word) >= 4) & word.rlike("[aeio]$"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def amount(text: Column) -> Column:
    """(value, cents_said) of the first amount in a text, or null; both fields are null for a written amount of zero.

    A number counts with the cents after "e", "virgola", "punto" or straight after the euro word; "virgola 4" is forty cents. A
    zero counts only with cents. Null and empty texts have none; runs of digits beyond 14 places aren't read.
    """
    tokens = F.regexp_extract_all(F.replace(_folded(text), F.lit("€"), F.lit(" euro ")), F.lit(WRITTEN + r"|\d+|[a-z]+"), F.lit(0))

    def read(tok: Column) -> Column:
        bare = F.when(F.contains(tok, F.lit(",")), F.translate(tok, ".", "")).otherwise(tok)
        return F.struct(tok.alias("tok"), F.when(tok.rlike(f"^(?:{WRITTEN})$"), F.translate(bare, ",", ".").try_cast(MONEY)).alias("written"), number(tok).alias("n"))

    def pick(read_tokens: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            here, following = F.get(read_tokens, i), lambda d: F.get(read_tokens, i + d)
            after = F.coalesce(following(F.lit(1))["tok"], F.lit(""))
            euro = after.isin(*EURO)
            skip = F.when(euro, 2).otherwise(1)
            joint = F.coalesce(following(skip)["tok"], F.lit(""))
            joined = joint.isin("e", *POINT)
            last = F.when(joined, following(skip + 1)).when(euro, following(skip))
            m = F.when(last["n"] < 100, last["n"])
            places = F.when(last["tok"].rlike("^[0-9]+$"), F.concat(F.lit("0."), last["tok"]).try_cast(MONEY)).otherwise(m / F.when(m < 10, 10).otherwise(100))
            cents = F.when(joint.isin(*POINT), places.cast(MONEY)).otherwise((m / 100).cast(MONEY))
            whole = here["n"].try_cast(MONEY)
            out = lambda value, said: F.struct(value.cast(MONEY).alias("value"), F.lit(said).alias("cents_said"))
            return (
                F.when(here["written"].isNotNull(), out(F.when(here["written"] > 0, here["written"]), True))
                .when(whole.isNull() | (whole == 0) & ~after.isin("e", *POINT, *EURO), None)
                .when(after.isin(*CENT) & (whole < 100), out(whole / 100, True))
                .when(m.isNotNull() & (whole + cents > 0), out(whole + cents, True))
                .when(whole > 0, out(whole, False))
            )

        return F.get(F.filter(F.transform(read_tokens, at), lambda s: s.isNotNull()), F.lit(0))

    # The tokens are read once, then looked at from every place.
    return F.get(F.transform(F.array(F.transform(tokens, read)), pick), F.lit(0))


def date(text: Column, today: Column) -> Column:
    """The first date that a text names, as said on the day ``today``; null if there is none.

    What is written in figures comes first, then days with a month, words like "ieri", weekdays, and days alone ("il 12", "primo
    del mese"). Without a year, a month or a week it is the last such day that isn't in the future; a weekday that is today's
    means today unless "scorso" follows. Days that a month doesn't have are no dates. Where several are of one kind the first
    counts. A null text or null today gives null, the latter only where a year isn't said.
    """
    return _let(F.struct(plain(text).alias("said"), today.alias("today")), lambda x: _date(x["said"], x["today"]))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _date(said: Column, today: Column) -> Column:
    year = F.year(today)

    def day(y: Column, m: Column, d: Column) -> Column:
        first = F.make_date(F.greatest(y, F.lit(1)), F.greatest(F.least(m, F.lit(12)), F.lit(1)), F.lit(1))
        return F.when((y >= 1) & m.between(1, 12) & d.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))

    def passed(m: Column, d: Column) -> Column:
        return _let(day(year, m, d), lambda this: F.when(this <= today, this).when(this.isNotNull(), day(year - 1, m, d)))

    def number_of(word: Column) -> Column:
        return _let(word, lambda w: F.coalesce(_map({o: n for n, o in enumerate(ORDINALS, 1)})[w], number(w).cast("int")))

    def chosen(d: Column, m: Column, y: Column) -> Column:
        return _let(F.struct(d.alias("d"), m.alias("m"), y.alias("y")), lambda x: F.when(x["y"].isNull(), passed(x["m"], x["d"])).otherwise(day(x["y"], x["m"], x["d"])))

    def written(hit: Column) -> Column:
        part = lambda i: F.get(F.split(hit, "[/.-]"), F.lit(i))
        d, m, y = (part(i).try_cast("int") for i in range(3))
        return chosen(d, m, F.when(F.length(part(2)) == 2, y + 2000).otherwise(y))

    def with_month(hit: Column) -> Column:
        names = {w: n for words in (MONTH_NAMES, MONTH_SHORT) for n, w in enumerate(words, 1)}
        return chosen(number_of(F.regexp_extract(hit, DATE_MONTH, 1)), _map(names)[F.regexp_extract(hit, DATE_MONTH, 2)], F.regexp_extract(hit, DATE_MONTH, 3).try_cast("int"))

    def relative(hit: Column) -> Column:
        return F.date_sub(today, F.when(hit.isin(*TODAY), 0).when(hit.isin(*YESTERDAY), 1).otherwise(2))

    def weekday(hit: Column) -> Column:
        back = F.pmod(F.weekday(today) - _map({w: n for n, w in enumerate(WEEKDAYS)})[F.regexp_extract(hit, DATE_WEEKDAY, 1)], F.lit(7))
        return F.date_sub(today, F.when((back == 0) & (F.regexp_extract(hit, DATE_WEEKDAY, 2) != ""), 7).otherwise(back))

    def alone(hit: Column) -> Column:
        # No month has fewer than 28 days, and of two in a row one has 31.
        months = [F.add_months(F.trunc(today, "month"), -k) for k in range(3)]
        d = number_of(F.concat(F.regexp_extract(hit, DATE_DAY, 1), F.regexp_extract(hit, DATE_DAY, 2)))
        return _let(d, lambda n: F.coalesce(*[_let(day(F.year(m), F.month(m), n), lambda at: F.when(at <= today, at)) for m in months]))

    def first_of(pattern: str, read) -> Column:
        return F.get(F.filter(F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(0)), read), lambda d: d.isNotNull()), F.lit(0))

    kinds = ((DATE_WRITTEN, written), (DATE_MONTH, with_month), (DATE_RELATIVE, relative), (DATE_WEEKDAY, weekday), (DATE_DAY, alone))
    return F.coalesce(*[first_of(pattern, read) for pattern, read in kinds])


def spell(n: Column, elide: bool = False) -> Column:
    """An integer from 0 to 999,999 as one word; ``elide`` writes centotto for centootto."""
    words = F.array(*[F.lit(w) for w in _said()])

    def below(v: Column) -> Column:
        h, rest = F.floor(v / 100).cast("int"), (v % 100).cast("int")
        small = F.get(words, rest)
        cento = F.when(F.startswith(small, F.lit("o")) & F.lit(elide), "cent").otherwise("cento")
        cento = F.when(rest == 0, "cento").otherwise(cento)
        return F.when(v < 100, small).otherwise(F.concat(F.when(h == 1, "").otherwise(F.get(words, h)), cento, F.when(rest == 0, "").otherwise(small)))

    t, rest = F.floor(n / 1000), n % 1000
    tail = F.when(rest == 0, "").otherwise(below(rest))
    return F.when(t == 0, below(n)).when(t == 1, F.concat(F.lit("mille"), tail)).otherwise(F.concat(below(t), F.lit("mila"), tail))
