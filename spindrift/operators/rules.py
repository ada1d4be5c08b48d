"""Clinical rules as column expressions: vital risk, symptoms, recommended level, fallback score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import hits

# Closed ranges of each vital sign, in the order in which they are judged.
CRITICAL = (("heartrate", "heart_rate", ((0, 50), (120, 999))), ("sbp", "systolic_bp", ((0, 80), (160, 999))), ("temperature", "temperature", ((0, 95.0), (101.0, 999))), ("o2sat", "oxygen_saturation", ((0, 90),)))
CONCERNING = {"heartrate": ((50, 60), (100, 120)), "sbp": ((140, 160), (80, 90)), "temperature": ((99.5, 101.0), (95.0, 97.0)), "o2sat": ((90, 95),)}
CRITICAL_SYMPTOMS = ("chest pain", "difficulty breathing", "shortness of breath", "unconscious", "unresponsive", "cardiac arrest", "stroke", "severe bleeding", "trauma", "overdose", "anaphylaxis", "seizure", "severe abdominal pain", "altered mental status")
FALLBACK_CRITICAL = ("chest pain", "shortness of breath", "unconscious", "cardiac arrest", "stroke", "seizure", "trauma", "bleeding", "shock")
FALLBACK_SEVERE = ("fever", "vomiting", "diarrhea", "headache", "abdominal pain", "dizziness", "weakness", "nausea")
PERIOD_FACTORS = (1.2, 1.0, 1.1, 1.3)
# What the levels mean.
LEVELS = (
    (1, "Critical", "Requires immediate resuscitation"),
    (2, "Emergent", "Requires urgent treatment within 10 minutes"),
    (3, "Urgent", "Requires treatment within 30 minutes"),
    (4, "Less Urgent", "Can wait 1-2 hours for treatment"),
    (5, "Non-urgent", "Can wait several hours or be referred"),
)
# What is noted for each time of day.
PERIOD_NOTES = ("Limited staffing, patient may delay care", "Normal staffing levels", "Peak hours, higher volume", "Higher acuity, weekend effects")


def _within(c: Column, ranges: tuple) -> Column:
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | c.between(float(lo), float(hi))
    return F.coalesce(out, F.lit(False))


def vital_risk() -> Column:
    """Struct of ``risk``, ``critical`` and ``concerning`` (names of vital signs).

    Critical is tested first on each; once one is critical, later ones aren't listed as
    concerning. Ranges are closed, so a border belongs to both. Null signs are passed over.
    """
    critical = [F.when(_within(F.col(c), r), F.lit(name)) for c, name, r in CRITICAL]
    concerning, any_critical = [], F.lit(False)
    for (c, name, _), bad in zip(CRITICAL, critical, strict=True):
        any_critical = any_critical | bad.isNotNull()
        concerning.append(F.when(~any_critical & _within(F.col(c), CONCERNING[c]), F.lit(name)))
    crit, conc = F.array_compact(F.array(*critical)), F.array_compact(F.array(*concerning))
    risk = F.when(F.size(crit) > 0, "critical").when(F.size(conc) > 0, "concerning").otherwise("normal")
    return F.struct(risk.alias("risk"), crit.alias("critical"), conc.alias("concerning"))


def critical_symptoms(complaint: Column, keywords: Column | None = None) -> Column:
    text = F.concat_ws(" ", complaint, keywords) if keywords is not None else complaint
    return hits(text, CRITICAL_SYMPTOMS)


def recommended_level(risk: Column, n_symptoms: Column, age: Column, pain: Column) -> Column:
    """Struct of ``level`` and ``reasons``. Age 0 and pain 0 are values, not gaps."""
    first = F.when((risk == "critical") | (n_symptoms > 1), 1).when((n_symptoms > 0) | (risk == "concerning"), 2).otherwise(3)
    old = F.coalesce((age < 2) | (age > 80), F.lit(False))
    hurt = F.coalesce(pain >= 8, F.lit(False))
    level = F.when((first > 2) & (old | hurt), 2).otherwise(first)
    reasons = F.array_compact(
        F.array(
            F.when(first == 1, F.lit("critical vital signs or several critical symptoms")),
            F.when((first == 2) & (n_symptoms > 0), F.lit("a critical symptom")),
            F.when((first == 2) & (n_symptoms == 0), F.lit("concerning vital signs")),
            F.when((first > 2) & old, F.lit("age")),
            F.when((first > 2) & ~old & hurt, F.lit("severe pain")),
        )
    )
    return F.struct(level.cast("int").alias("level"), reasons.alias("reasons"))


def period_factor(period: Column) -> Column:
    return F.coalesce(*[F.when(period == i, F.lit(f)) for i, f in enumerate(PERIOD_FACTORS)], F.lit(1.0))


def period_note(period: Column) -> Column:
    return F.coalesce(*[F.when(period == i, F.lit(n)) for i, n in enumerate(PERIOD_NOTES)], F.lit("Time period not specified"))


def level_name(level: Column) -> Column:
    return F.coalesce(*[F.when(level == i, F.lit(n)) for i, n, _ in LEVELS])


def level_table(spark: SparkSession) -> DataFrame:
    """``level, name, description``, to be joined by broadcast."""
    return spark.createDataFrame(LEVELS, "level int, name string, description string")


def fallback(complaint: Column, hr: Column, sbp: Column, temperature: Column, o2sat: Column, pain: Column, age: Column) -> Column:
    """Struct of ``level`` (1 to 4) and ``confidence`` without a model; missing values take normal ones."""
    hr, sbp, temperature, o2sat, pain, age = (F.coalesce(c, F.lit(d)) for c, d in ((hr, 80.0), (sbp, 120.0), (temperature, 98.6), (o2sat, 98.0), (pain, 5.0), (age, 50.0)))
    score = sum((x.cast("int") for x in ((hr > 100) | (hr < 60), (sbp < 90) | (sbp > 180), temperature > 100.4, o2sat < 95, pain > 7)), F.lit(0))
    critical, severe = F.size(hits(complaint, FALLBACK_CRITICAL)) > 0, F.size(hits(complaint, FALLBACK_SEVERE)) > 0
    level = F.when(critical | (score >= 3), 1).when(severe | (score >= 2) | (age > 65), 2).when((score >= 1) | (pain > 5), 3).otherwise(4)
    confidence = F.when(level == 1, 0.85).when(level == 2, 0.75).when(level == 3, 0.70).otherwise(0.80)
    return F.struct(level.cast("int").alias("level"), confidence.alias("confidence"))


def age_band(age: Column) -> Column:
    return F.when(age.isNull(), "unknown").when(age < 18, "pediatric").when(age < 65, "adult").otherwise("elderly")


def adaptive_k(base: int, pain: Column, age: Column, hr: Column, sbp: Column, period: Column) -> Column:
    """More neighbours for pain, the very young or old, abnormal signs and nights; at most twice ``base``."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    k = F.lit(base) + 2 * yes(pain > 7) + yes((age < 18) | (age > 80)) + yes((hr < 50) | (hr > 120)) + yes((sbp < 90) | (sbp > 160)) + yes(period == 0)
    return F.least(k, F.lit(2 * base))


# Complaints that are red flags, and the scores from which a flag of a kind is raised.
RED_FLAGS = {"critical": ("胸痛", "呼吸困难", "意识丧失", "大出血", "严重创伤"), "urgent": ("高烧", "剧烈腹痛", "持续呕吐", "严重头痛", "肢体麻木")}
RED_FLAG_SCORES = {"critical": 0.9, "urgent": 0.7, "normal": 0.3}


def red_flag(complaint: Column, score: Column | None = None) -> Column:
    """``critical`` or ``urgent`` if the complaint names such a flag or the score reaches its threshold, else ``normal``; the first that applies."""
    out = None
    for kind in ("critical", "urgent"):
        named = F.exists(F.array(*map(F.lit, RED_FLAGS[kind])), lambda w: F.contains(F.coalesce(complaint, F.lit("")), w))
        applies = named if score is None else named | F.coalesce(score >= RED_FLAG_SCORES[kind], F.lit(False))
        out = F.when(applies, kind) if out is None else out.when(applies, kind)
    return out.otherwise("normal")


def model_for(preference: Column, load: Column) -> Column:
    """Which model answers: the quick one under a load over 0.8 or if ``fast`` is preferred, else the detailed one."""
    return F.when((load > 0.8) | (preference == "fast"), "tfidf_rf").otherwise("llama_rag")
