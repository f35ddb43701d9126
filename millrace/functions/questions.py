"""Type and difficulty of a Polish question, by ordered patterns (built-in expressions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each question type, in order of preference; factual is what none matches.
TYPES = {
    "comparative": [r"\bporówna[jć]\b", r"\bróżni[acę]\b", r"\bróżnica\b", r"\bróżni się\b", r"\bmiędzy\b.{1,40}\ba\b", r"\ba\b.{1,20}\b(CSRD|SFDR|Taksonomia|CSDDD|rozporządzenie)\b", r"\bw porównaniu\b", r"\bjak.{1,10}(odnosi się|ma się)\b.{1,30}\b(do|wobec)\b", r"\brelacj[aei] między\b"],
    "scope": [r"\bkto\b", r"\bkogo\b", r"\bjakie (podmioty|spółki|przedsiębiorstwa|jednostki|firmy)\b", r"\bkto (jest|są) (objęt|zobowiązan|zobligovan)\b", r"\bzakres podmiotowy\b", r"\bwyłącze(ni[ae]|ny|nia)\b", r"\bkto nie podlega\b", r"\bkto jest zwolnion\b", r"\bobjęt[aey] (obowiązkiem|przepisami|dyrektywą)\b", r"\bkwalifikuje się\b", r"\bpróg\b.{1,30}\bpracownik\b", r"\bpróg\b.{1,30}\bprzychodów\b"],
    "process": [r"\bjak (należy|trzeba|powinno|się)\b", r"\bprocedura\b", r"\bkroki\b", r"\betapy\b", r"\btermin\b.{1,30}\b(złożenia|przekazania|ujawnienia|raportowania)\b", r"\bdo kiedy\b", r"\bw jaki sposób\b", r"\bw jakim terminie\b", r"\bwnioskować\b", r"\bsporządzić\b", r"\bprzedstawić\b", r"\bjak (przygotować|opracować|sporządzić)\b"],
    "compliance": [r"\bobowiązek\b", r"\bwymóg\b", r"\bwymaga\b", r"\bco (trzeba|musi|należy|powinno)\b", r"\braportowa[ćć]\b", r"\bujawnić\b", r"\bujawnienie\b", r"\bzgodność\b", r"\bzgodnie z\b", r"\bspełni[ćc]\b.{1,20}\bkryteria\b", r"\bco (zawiera|musi zawierać)\b.{1,20}\braport\b"],
}
# Patterns of hard and of easy questions.
HARD = [r"\bporówna[jć]\b", r"\bróżni[acę]\b", r"\bsyntezu[ij]\b", r"\brelacja między\b", r"\bwzajemn[aey]\b", r"\bkombinacj[aei]\b", r"\bjednocześnie\b.{1,40}\b(CSRD|SFDR|Taksonomia)\b", r"\bimplikacj[aei]\b", r"\bjak (łączy|integruje|koreluje)\b", r"\bwieloaspektow\b", r"\bkonflik[ct]\b.{1,20}\bprzepis\b", r"\bspójno[śs][ćc]\b.{1,30}\b(CSRD|SFDR|Taksonomia)\b"]
EASY = [r"\bco (to jest|oznacza|to)\b", r"\bjak (definiuje|jest definiowany|jest zdefiniowany)\b", r"\bjaka jest definicja\b", r"\bw (którym|jakim) roku\b", r"\bkiedy wchodzi w życie\b", r"\bjakie są progi\b", r"\bjak brzmi\b", r"\bco to znaczy\b", r"\bjakie są cele\b"]


def _hits(low: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [low.rlike(f"(?U){p}").cast("int") for p in patterns])


def question_type(text: Column) -> Column:
    """First type with a match in the lower-cased question."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike("(?U)" + "|".join(ps)), F.lit(name)) for name, ps in TYPES.items()], F.lit("factual"))


def difficulty(text: Column, long_chars: int = 140) -> Column:
    hard, easy = _hits(F.lower(text), HARD), _hits(F.lower(text), EASY)
    return F.when((hard >= 2) | ((hard >= 1) & (F.length(text) > long_chars)), "hard").when((easy >= 1) & (hard == 0), "easy").otherwise("medium")
