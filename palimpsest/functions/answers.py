"""Take the answer out of raw model output.

Each (system, setting) pair has a short list of steps, tried in order; the first whose marker
occurs in the text gives the answer. The steps are data: one CASE picks the step of a row, and the
text is then cut as that step says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.lexicon import WS
from palimpsest.functions.text import balance_quote, first_sentence, strip, strip_markup

FIRST, LAST, WHOLE = 2, -1, None   # which piece around the marker is taken
STOP, SENTENCE, END = "stop", "sentence", "end"   # where the piece ends

# Answer markers, without their first letter so that both cases match.
HEALTHY, DEMENTIA = "ealthy:", "ementia:"
OUTPUT_SENTENCE, OUTPUT, REWRITE = "utput sentence:", "utput:", "ewrite:"
REWRITTEN_SENTENCE, SOURCE = "ewritten sentence:", "ource:"
LEAD_WORD = "Dementia:"


@dataclass(frozen=True)
class Step:
    marker: str = ""            # "" always applies
    piece: int | None = WHOLE
    until: str = STOP
    led: bool | None = None     # only if the text does / does not begin with LEAD_WORD
    trimmed: bool = False       # read from the text without outer blanks

    def applies(self, text: Column) -> Column:
        test = text.contains(self.marker) if self.marker else F.lit(True)
        if self.led is None:
            return test
        leads = text.rlike(f"^{WS}*{LEAD_WORD}( |{WS}*$)")
        return test & (leads if self.led else ~leads)


BLANK_ANSWER = "blank"
ANY = None

PHI3, MISTRAL, GEMMA, LLAMA3 = "phi3:instruct", "mistral:instruct", "gemma:2b-instruct", "llama3:instruct"

# The steps per system and setting. A setting not listed falls to ANY, then to the
# unchanged text.
RULES: dict[str, dict[str | None, tuple[Step, ...] | str]] = {
    PHI3: {
        "ZS": (Step(HEALTHY, LAST), Step()),
        "FS": (Step(HEALTHY, LAST), Step()),
        "KB": (Step(OUTPUT_SENTENCE, FIRST), Step(OUTPUT, FIRST)),
    },
    MISTRAL: {
        "ZS": (Step(HEALTHY, FIRST, SENTENCE, led=True), Step(DEMENTIA, FIRST, SENTENCE, led=True, trimmed=True)),
        "FS": (Step(HEALTHY, FIRST, led=True), Step(DEMENTIA, FIRST, led=True), Step(HEALTHY, LAST, led=False)),
        ANY: (Step(),),
    },
    GEMMA: {
        "ZS": BLANK_ANSWER,
        "FS": BLANK_ANSWER,
        "KB": tuple(Step(m, FIRST) for m in (REWRITE, OUTPUT_SENTENCE, REWRITTEN_SENTENCE, OUTPUT, SOURCE)),
    },
    LLAMA3: {
        "ZS": BLANK_ANSWER,
        "FS": BLANK_ANSWER,
        "KB": tuple(Step(m, FIRST) for m in (OUTPUT, HEALTHY, SOURCE)),
    },
}

# Systems whose answer also ends at the first semicolon.
CUT_AT_SEMICOLON = (PHI3,)


def _literal(step: Step, cut: bool) -> Column:
    """A step as a struct of constants, so that the text is cut in one place only."""
    return F.struct(
        F.lit(step.marker).alias("marker"), F.lit(step.piece or 0).alias("piece"), F.lit(step.until).alias("until"),
        F.lit(step.trimmed).alias("trimmed"), F.lit(cut).alias("cut"))


_KEEP, _BLANK = Step(until=END), Step(until=BLANK_ANSWER)


def choose_step(text: Column, system: Column, setting: Column) -> Column:
    """The step that applies to a row, as a struct."""
    chosen = None
    for name, by_setting in RULES.items():
        cut = name in CUT_AT_SEMICOLON
        named = [key for key in by_setting if key is not ANY]
        for key, steps in by_setting.items():
            here = (system == name) & (~setting.isin(*named) if key is ANY else setting == key)
            for step in (_BLANK,) if steps == BLANK_ANSWER else steps:
                found = _literal(step, cut)
                chosen = (F if chosen is None else chosen).when(here & step.applies(text), found)
        if cut:
            chosen = chosen.when(system == name, _literal(_KEEP, True))
    return chosen.otherwise(_literal(_KEEP, False))


def apply_step(text: Column, step: Column) -> Column:
    source = F.when(step["trimmed"], strip(text)).otherwise(text)
    part = F.when(step["piece"] == 0, source).otherwise(F.split_part(source, step["marker"], step["piece"]))
    answer = (F.when(step["until"] == STOP, F.split_part(part, F.lit("."), F.lit(1)))
              .when(step["until"] == SENTENCE, first_sentence(part))
              .when(step["until"] == BLANK_ANSWER, F.lit("")).otherwise(part))
    return F.when(step["cut"], F.split_part(answer, F.lit(";"), F.lit(1))).otherwise(answer)


def extract_answer(df: DataFrame, text: str, name: str = "answer", system: str = "system", setting: str = "setting") -> DataFrame:
    """``text`` is already free of markup; an unknown system leaves it unchanged.

    Works on a table, step by step, so that each text is searched and cut once per row; as one
    nested expression the parts would be repeated in the generated code.
    """
    chosen = df.withColumn("_step", choose_step(F.col(text), F.col(system), F.col(setting)))
    return chosen.withColumn(name, apply_step(F.col(text), F.col("_step"))).drop("_step")


def clean_generated(df: DataFrame, raw: str, name: str = "adv_text", system: str = "system", setting: str = "setting") -> DataFrame:
    """Markup out, answer taken, first sentence kept, quote balanced. Empty text stays empty."""
    bare = df.withColumn("_bare", strip_markup(F.col(raw)))
    answered = extract_answer(bare, "_bare", "_answer", system, setting)
    cut = answered.withColumn("_first", first_sentence(F.col("_answer")))
    kept = F.when(F.col("_bare") == "", F.lit("")).otherwise(balance_quote(F.col("_first")))
    # the one-element explode is a fence: a later filter on the result would otherwise be pushed below
    # these steps, with all of their expressions written out in it again
    return cut.select(*[c for c in df.columns if c != name], F.explode(F.array(kept)).alias(name))
