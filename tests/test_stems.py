"""Stems against published pairs, Turkish case and repaired encodings."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import stems

#: Words and stems as the published vocabularies of the algorithms give them.
PAIRS = {
    "en": "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist "
    "consistently consist consolation consol consolations consol consolatory consolatori console consol consoling consol consolingly consol consonant conson "
    "knack knack knackeries knackeri knacks knack knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel knees knee "
    "knight knight knightly knight knights knight knit knit knocked knock knots knot dying die news news generously generous generate generat communism communism "
    "happy happi enjoy enjoy relational relat conditional condit hopping hop hoping hope falling fall agreed agre skies sky gas gas this this gaps gap",
    "de": "aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg aufeinanderfolgend aufeinanderfolg "
    "aufeinanderschlügen aufeinanderschlug auferlegt auferlegt auferlegten auferlegt auferstanden auferstand auferstehen aufersteh auferstehung aufersteh auferwachen auferwach "
    "aufessen aufess auffahren auffahr kategorie kategori kategorien kategori kategorisch kategor kater kat kauen kau kaufen kauf kaufleute kaufleut kaum kaum kätzchen katzch",
    "fr": "continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel "
    "continuelle continuel continuellement continuel continuelles continuel continuels continuel continuer continu continuerait continu continuez continu continuité continu "
    "contorsions contors contour contour contournait contourn contours contour contractait contract contraction contract contradictoirement contradictoir contraindre contraindr main main mains main "
    "majesté majest majestueusement majestu majorité major maintenant mainten maintenir mainten maintenue maintenu",
    "es": "cheque chequ cheques chequ chica chic chicago chicag chicas chic chico chic chicos chic chihuahua chihuahu chilango chilang torneo torne tornillo tornill "
    "torneos torne torniquete torniquet torpedearon torped torpeza torpez torres torr toros tor tortura tortur torturando tortur torturas tortur cheyene cheyen chicanas chican",
}


@pytest.mark.parametrize("language", PAIRS)
def test_published_pairs(language):
    words = PAIRS[language].split()
    got = {w: stems.stem_of(w, language) for w in words[::2]}
    assert got == dict(zip(words[::2], words[1::2]))


def test_stems_are_joined_back(spark):
    rel = spark.createDataFrame([(1, "en", "knees"), (1, "en", "knees"), (2, "de", "kaufen"), (3, "xx", "knees"), (4, None, "knees"), (5, "fr", "x2s"), (6, "es", "")], "unit_id int, lang string, term string")
    got = sorted((r.unit_id, r.stem) for r in stems.stemmed(rel).collect())
    assert got == [(1, "knee"), (1, "knee"), (2, "kauf"), (3, "knees"), (4, "knees"), (5, "x2s"), (6, "")]
    for stem in stems.STEMMERS.values():
        for word in ("", "a", "é", "y", "ya", "qu", "'", "''s", "ss", "ement", "logía", "x" * 500):
            assert isinstance(stem(word), str)


def test_turkish_case(spark):
    cases = {"İSTANBUL": "istanbul", "IŞIK": "ışık", "ışık": "ışık", "KURUM I": "kurum ı", "": "", None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert all(r[0] == r[1] for r in df.select(stems.lowered_turkish(F.col("t")), "want").collect())


def test_repaired_encodings(spark):
    fine = ["Über naïve Æther", "plain", "", None, "Ã is a letter", "中文 Ã©", "aÂ b".replace("Â", ""), "é", "tab\t\x81"]
    broken = {"Über": "Ãœber", "naïve café": "naÃ¯ve cafÃ©", "it’s “so” – €5": "itâ€™s â€œsoâ€\x9d â€“ â‚¬5", "ñ中": "ñ中".encode().decode("latin-1"), "é": "é".encode().decode("latin-1").encode().decode("latin-1")}
    rows = [(t, t) for t in fine] + [(b, g) for g, b in broken.items()]
    df = spark.createDataFrame(rows, "t string, want string")
    got = df.select(stems.repaired(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
