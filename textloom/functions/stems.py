"""Stems of English, German, French and Spanish words by the Snowball rules.

Each language is its regions and its tables of endings; the longest ending that fits is looked at, and only that. Stems are
made once for each distinct term (``stemmed``), so the Python below runs over a vocabulary and not over a corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vowels, endings and exceptions of the published stemming rules, by language.
_EN_VOWELS, _DE_VOWELS, _FR_VOWELS, _ES_VOWELS = "aeiouy", "aeiouyäöü", "aeiouyâàëéêèïîôûù", "aeiouáéíóúü"
_EN_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_DE_FIRST, _DE_SECOND, _DE_THIRD = "em ern er e en es s".split(), "en er est st".split(), "end ung ig ik isch lich heit keit".split()
_FR_GONE = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_ATION = "atrice ateur ation atrices ateurs ations".split()
_FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
    "issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_GONE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_ADORA = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_E = "en es éis emos".split()
_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás "
    "iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando "
    "iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos "
    "imos áramos iéramos iésemos ásemos"
).split()


def _ending(word: str, endings: Iterable[str], region: int = 0) -> str | None:
    """The longest of the endings that the word has from ``region`` on."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= region), key=len, default=None)


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first other letter that follows a vowel begins; the word's end if none does."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def english(word: str) -> str:
    word = word.replace("’", "'")
    if len(word) <= 2 or word in _EN_WHOLE:
        return _EN_WHOLE.get(word, word)
    v = f"[{_EN_VOWELS}]"
    w = re.sub(f"(^|(?<={v}))y", "Y", word.removeprefix("'"))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _after(w, _EN_VOWELS)
    r2 = _after(w, _EN_VOWELS, r1)

    def short(x: str) -> bool:
        return bool(re.search(f"(^|[^{_EN_VOWELS}])[{_EN_VOWELS}][^{_EN_VOWELS}wxY]$", x) if len(x) > 2 else re.search(f"^{v}[^{_EN_VOWELS}]$", x))

    w = re.sub("('s'|'s|')$", "", w)
    end = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and re.search(v, w[:-2]):
        w = w[:-1]
    if w in _EN_LATER:
        return w
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search(v, w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif len(w) <= r1 and short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_VOWELS:
        w = w[:-1] + "i"
    end = _ending(w, _EN_STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple("cdeghkmnrt")):
            w = before + _EN_STEP2[end]
    end = _ending(w, _EN_STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _EN_STEP3[end]
    end = _ending(w, _EN_STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not short(w[:-1])) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def german(word: str) -> str:
    v = f"[{_DE_VOWELS}]"
    w = re.sub(f"(?<={v})([uy])(?={v})", lambda m: m[1].upper(), word.replace("ß", "ss"))
    r1 = _after(w, _DE_VOWELS)
    r2 = _after(w, _DE_VOWELS, r1)
    r1 = max(r1, 3)
    end = _ending(w, _DE_FIRST)
    if end and len(w) - len(end) >= r1 and (end != "s" or w[-2] in "bdfghklmnrt"):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _ending(w, _DE_SECOND)
    if end and len(w) - len(end) >= r1 and (end != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(end)]
    end = _ending(w, _DE_THIRD)
    if end and len(w) - len(end) >= r2:
        less = w[: -len(end)]
        if end in ("end", "ung"):
            w = less
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            w = w if less.endswith("e") else less
        elif end in ("lich", "heit"):
            w = less[:-2] if less.endswith(("er", "en")) and len(less) - 2 >= r1 else less
        else:
            more = _ending(less, ("lich", "ig"), r2)
            w = less[: -len(more)] if more else less
    return w.translate(str.maketrans("UYäöü", "uyaou"))


def french(word: str) -> str:
    v, o = f"[{_FR_VOWELS}]", f"[^{_FR_VOWELS}]"
    w = re.sub(f"(?<={v})([ui])(?={v})", lambda m: m[1].upper(), word)
    w = re.sub(f"(?<={v})y|y(?={v})", "Y", w).replace("qu", "qU")
    if re.match(f"{v}{v}|par|col|tap", w):
        rv = min(3, len(w))
    else:
        m = re.compile(v).search(w, 1)
        rv = m.end() if m else len(w)
    r1 = _after(w, _FR_VOWELS)
    r2 = _after(w, _FR_VOWELS, r1)
    start, verbs = w, False

    def back(x: str, end: str, region: int) -> bool:
        return x.endswith(end) and len(x) - len(end) >= region

    end = _ending(w, [*_FR_GONE, *_FR_ATION, *"logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()])
    less = w[: -len(end)] if end else w
    at = len(less)
    if end in _FR_GONE:
        w = less if at >= r2 else w
    elif end in _FR_ATION and at >= r2:
        w = less
        if w.endswith("ic"):
            w = w[:-2] if back(w, "ic", r2) else w[:-2] + "iqU"
    elif end in ("logie", "logies"):
        w = less + "log" if at >= r2 else w
    elif end in ("usion", "ution", "usions", "utions"):
        w = less + "u" if at >= r2 else w
    elif end in ("ence", "ences"):
        w = less + "ent" if at >= r2 else w
    elif end in ("ement", "ements") and at >= rv:
        w = less
        if back(w, "iv", r2):
            w = w[:-2]
            w = w[:-2] if back(w, "at", r2) else w
        elif w.endswith("eus"):
            w = w[:-3] if back(w, "eus", r2) else w[:-1] + "x" if back(w, "eus", r1) else w
        elif w.endswith(("abl", "iqU")):
            w = w[:-3] if len(w) - 3 >= r2 else w
        elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
            w = w[:-3] + "i"
    elif end in ("ité", "ités") and at >= r2:
        w = less
        if w.endswith("abil"):
            w = w[:-4] if back(w, "abil", r2) else w[:-4] + "abl"
        elif w.endswith("ic"):
            w = w[:-2] if back(w, "ic", r2) else w[:-2] + "iqU"
        elif back(w, "iv", r2):
            w = w[:-2]
    elif end in ("if", "ive", "ifs", "ives") and at >= r2:
        w = less
        if back(w, "at", r2):
            w = w[:-2]
            if w.endswith("ic"):
                w = w[:-2] if back(w, "ic", r2) else w[:-2] + "iqU"
    elif end == "eaux":
        w = w[:-1]
    elif end == "aux":
        w = less + "al" if at >= r1 else w
    elif end in ("euse", "euses"):
        w = less if at >= r2 else less + "eux" if at >= r1 else w
    elif end in ("issement", "issements"):
        w = less if at >= r1 and re.search(f"{o}$", less) else w
    elif end in ("amment", "emment") and at >= rv:
        w, verbs = less + end[0].replace("a", "ant").replace("e", "ent"), True
    elif end in ("ment", "ments") and re.search(f"{v}$", less) and at > rv:
        w, verbs = less, True
    if w == start or verbs:
        was = w
        end = _ending(w, _FR_I, rv)
        if end and len(w) - len(end) > rv and re.search(f"{o}$", w[: -len(end)]):
            w = w[: -len(end)]
        if w == was:
            end = _ending(w, ["ions", *_FR_E, *_FR_A], rv)
            if end == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif end in _FR_E:
                w = w[: -len(end)]
            elif end:
                w = w[: -len(end)]
                w = w[:-1] if back(w, "e", rv) else w
    if w != start:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if re.search("[^aiouès]s$", w):
            w = w[:-1]
        end = _ending(w, ("ion", "ier", "ière", "Ier", "Ière", "e"), rv)
        if end == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st" else w
        elif end:
            w = w[: -len(end)] + ("i" if len(end) > 2 else "")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè]({o}+)$", r"e\1", w)
    return w.translate(str.maketrans("UIY", "uiy"))


def spanish(word: str) -> str:
    w, v = word, _ES_VOWELS
    plain = str.maketrans("áéíóú", "aeiou")
    if len(w) < 2:
        rv = len(w)
    elif w[1] not in v:
        m = re.compile(f"[{v}]").search(w, 2)
        rv = m.end() if m else len(w)
    elif w[0] in v:
        m = re.compile(f"[^{v}]").search(w, 2)
        rv = m.end() if m else len(w)
    else:
        rv = min(3, len(w))
    r1 = _after(w, v)
    r2 = _after(w, v, r1)
    end = _ending(w, _ES_PRONOUNS, rv)
    if end:
        less = w[: -len(end)]
        verb = _ending(less, "iéndo ándo ár ér ír ando iendo ar er ir yendo".split(), rv)
        if verb in ("iéndo", "ándo", "ár", "ér", "ír"):
            w = less[: -len(verb)] + verb.translate(plain)
        elif verb and (verb != "yendo" or less.endswith("uyendo")):
            w = less
    start = w
    end = _ending(w, [*_ES_GONE, *_ES_ADORA, *"logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos".split()])
    less = w[: -len(end)] if end else w
    at = len(less)

    def cut(x: str, *ends: str) -> str:
        e = _ending(x, ends, r2)
        return x[: -len(e)] if e else x

    if end == "amente":
        if at >= r1:
            w = cut(less, "iv", "os", "ic", "ad")
            w = cut(w, "at") if w != less and less.endswith("iv") else w
    elif end and at >= r2:
        w = {"log": less + "log", "uci": less + "u", "enc": less + "ente"}.get(end[:3] if end not in _ES_GONE and end not in _ES_ADORA else "", less)
        if end in _ES_ADORA:
            w = cut(w, "ic")
        elif end == "mente":
            w = cut(w, "ante", "able", "ible")
        elif end in ("idad", "idades"):
            w = cut(w, "abil", "ic", "iv")
        elif end in ("iva", "ivo", "ivas", "ivos"):
            w = cut(w, "at")
    if w == start:
        end = _ending(w, _ES_Y, rv)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _ending(w, [*_ES_E, *_ES_VERB], rv)
            if end:
                w = w[: -len(end)]
                w = w[:-1] if end in _ES_E and w.endswith("gu") else w
    end = _ending(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if end:
        w = w[: -len(end)]
        w = w[:-1] if end in "eé" and w.endswith("gu") and len(w) > rv else w
    return w.translate(plain)


STEMMERS: Mapping[str, Callable[[str], str]] = {"en": english, "de": german, "fr": french, "es": spanish}


def stem_of(word: str, language: str | None) -> str:
    """The stem of a lower-case word; in an unknown language, or with a digit, the word itself."""
    made = STEMMERS.get(language or "")
    return word if made is None or any(c.isdigit() for c in word) else made(word)


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([w if w is None else stem_of(w, lang) for w, lang in zip(words, languages)], dtype=object)


def vocabulary(terms: DataFrame, language: str = "lang", term: str = "term") -> DataFrame:
    """(language, term, stem) of each distinct pair."""
    return terms.select(language, term).distinct().withColumn("stem", _stems(F.col(term), F.col(language)))


def stemmed(rel: DataFrame, language: str = "lang", term: str = "term") -> DataFrame:
    """``rel`` with ``stem``: each term's, by the row's language. A null language leaves the term as it is."""
    known = vocabulary(rel.where(F.col(language).isNotNull()), language, term)
    return rel.join(known, [language, term], "left").withColumn("stem", F.coalesce("stem", term)).select(*rel.columns, "stem")


def lowered_turkish(text: Column) -> Column:
    """Lower case with dotted and dotless i told apart, whatever the JVM's locale."""
    return F.lower(F.translate(text, "Iİ", "ıi"))


# What bytes 80 to 9F are in code page 1252; five are not used.
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def repaired(text: Column, rounds: int = 2) -> Column:
    """UTF-8 that was read as Latin-1 or code page 1252, put right.

    The characters are turned back to the bytes that they were. A text is changed only if all of it can be bytes, some
    of them look like a longer UTF-8 character, and all of them are valid UTF-8; ``rounds`` times, for text that was misread twice.
    """
    for _ in range(rounds):
        back = F.translate(text, _CP1252, "".join(map(chr, range(0x80, 0xA0))))
        raw = F.encode(back, "ISO-8859-1")
        fits = back.rlike("[\\u00c2-\\u00f4][\\u0080-\\u00bf]") & ~back.rlike("[^\\u0000-\\u00ff]")
        text = F.when(fits & F.call_function("is_valid_utf8", raw.cast("string")), F.decode(F.when(fits, raw), "UTF-8")).otherwise(text)
    return text
