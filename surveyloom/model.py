"""Schemas, screening rules and the fixed tables of the instrument."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# ---------------------------------------------------------------- schemas

RESPONSES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("item", T.StringType(), False),
        T.StructField("answer", T.StringType(), True),
    ]
)

ITEMS = T.StructType(
    [
        T.StructField("Item", T.StringType(), True),
        T.StructField("Question", T.StringType(), False),
        T.StructField("Trait", T.StringType(), True),
        T.StructField("Content", T.StringType(), True),
    ]
)

# ---------------------------------------------------------------- screening


@dataclass(frozen=True)
class Limit:
    """One threshold: ``column < value``, or ``<=`` when inclusive."""

    column: str
    value: float
    inclusive: bool = False

    def condition(self) -> Column:
        measure = F.col(self.column)
        return measure <= F.lit(self.value) if self.inclusive else measure < F.lit(self.value)


@dataclass(frozen=True)
class ScreeningRules:
    """A conjunction of limits; a NULL measure makes it NULL unless another limit fails."""

    limits: tuple[Limit, ...]

    def condition(self) -> Column:
        return reduce(and_, [limit.condition() for limit in self.limits])


# The limits used for each purpose.
COMPLETION = ScreeningRules((Limit("miss_c", 0.5), Limit("miss_p", 0.5), Limit("sincere", 5), Limit("infreq", 1)))
RASCH_SAMPLE = ScreeningRules((Limit("miss_c", 0.5), Limit("sincere", 5, True)))
RESAMPLE_SAMPLE = ScreeningRules((Limit("miss_p", 0.2), Limit("infreq", 0.75)))
PROFILE_SAMPLE = ScreeningRules((Limit("miss_p", 0.33), Limit("infreq", 1)))

# ---------------------------------------------------------------- fixed tables

# Answer labels of the two five-point scales.
LIKERT = [
    ("Very Accurate", 5),
    ("Moderately Accurate", 4),
    ("Neither Accurate nor Inaccurate", 3),
    ("Moderately Inaccurate", 2),
    ("Very Inaccurate", 1),
    ("Strongly Agree", 5),
    ("Moderately Agree", 4),
    ("Neither Agree nor Disagree", 3),
    ("Moderately Disagree", 2),
    ("Strongly Disagree", 1),
]
LIKERT_TOP = 5
DONT_KNOW = "I don't know"

# The right option of each keyed item.
ANSWER_KEY = [
    ("3D_Q16", "E"),
    ("3D_Q24", "C"),
    ("3D_Q29", "F"),
    ("3D_Q42", "E"),
    ("3D_Q58", "C"),
    ("Analogies_Q14", "C"),
    ("Analogies_Q25", "A"),
    ("Analogies_Q4", "E"),
    ("Analogies_Q5", "D"),
    ("Analogies_Q8", "H"),
    ("Matrix_Q43", "D"),
    ("Matrix_Q48", "D"),
    ("Matrix_Q50", "E"),
    ("Matrix_Q53", "C"),
    ("Matrix_Q55", "D"),
    ("Pattern_Q1", "169"),
    ("Pattern_Q3", "47"),
    ("Pattern_Q35", "S"),
    ("Pattern_Q58", "N"),
    ("Pattern_Q6", "F"),
    ("Verbal_Q14", "8"),
    ("Verbal_Q16", "It's impossible to tell"),
    ("Verbal_Q17", "47"),
    ("Verbal_Q32", "Thursday"),
    ("Verbal_Q4", "5"),
]

# Questions of the 27 scales as (scale, item, sign); sign -1 marks a question scored in reverse.
SCALE_KEY = [
    ("Problem_Solving", "Q1_A_1", 1),
    ("Problem_Solving", "Q1_A_2", 1),
    ("Problem_Solving", "Q1_A_3", 1),
    ("Problem_Solving", "Q1_A_4", 1),
    ("Problem_Solving", "Q1_A_5", 1),
    ("Depth_Thought", "Q3_A_1", 1),
    ("Depth_Thought", "Q3_A_2", 1),
    ("Depth_Thought", "Q3_A_3", 1),
    ("Depth_Thought", "Q3_A_4", 1),
    ("Depth_Thought", "Q3_A_5", 1),
    ("Depth_Thought", "Q3_A_6", 1),
    ("Depth_Thought", "Q3_A_7", 1),
    ("Mental_Quickness", "Q4_A_1", 1),
    ("Mental_Quickness", "Q4_A_2", 1),
    ("Mental_Quickness", "Q4_A_3", 1),
    ("Mental_Quickness", "Q4_A_4", 1),
    ("Mental_Quickness", "Q4_A_5", 1),
    ("Mental_Quickness", "Q4_A_6", 1),
    ("Mental_Quickness", "Q4_A_7", 1),
    ("Need_Cognition", "Q5_A_1", 1),
    ("Need_Cognition", "Q5_A_2", 1),
    ("Need_Cognition", "Q5_A_3", 1),
    ("Need_Cognition", "Q5_A_4", 1),
    ("Need_Cognition", "Q5_A_5", 1),
    ("Need_Cognition", "Q5_A_6", 1),
    ("Love_Learning", "Q6_A_1", 1),
    ("Love_Learning", "Q6_A_2", 1),
    ("Love_Learning", "Q6_A_3", 1),
    ("Love_Learning", "Q6_A_4", 1),
    ("Love_Learning", "Q6_A_5", 1),
    ("Love_Learning", "Q6_A_6", 1),
    ("Creativity", "Q7_A_1", 1),
    ("Creativity", "Q7_A_2", 1),
    ("Creativity", "Q7_A_3", 1),
    ("Creativity", "Q7_A_4", 1),
    ("Creativity", "Q7_A_5", 1),
    ("Creativity", "Q7_A_6", 1),
    ("Creativity", "Q7_A_7", 1),
    ("Creativity", "Q7_A_8", 1),
    ("Creativity", "Q7_A_9", 1),
    ("Creativity", "Q7_A_10", 1),
    ("Creativity", "Q7_A_11", 1),
    ("Creativity", "Q7_A_12", 1),
    ("Creativity", "Q7_A_13", 1),
    ("Concientiousness", "Q8_A_1", 1),
    ("Concientiousness", "Q8_A_2", 1),
    ("Concientiousness", "Q8_A_3", 1),
    ("Concientiousness", "Q8_A_4", 1),
    ("Concientiousness", "Q8_A_5", 1),
    ("Concientiousness", "Q8_A_6", 1),
    ("Concientiousness", "Q8_A_7", 1),
    ("Concientiousness", "Q8_A_8", 1),
    ("Concientiousness", "Q8_A_9", 1),
    ("Concientiousness", "Q8_A_10", 1),
    ("Orderliness", "Q9_A_1", 1),
    ("Orderliness", "Q9_A_2", 1),
    ("Orderliness", "Q9_A_3", 1),
    ("Orderliness", "Q9_A_4", 1),
    ("Orderliness", "Q9_A_5", 1),
    ("Deprivation_Sensitivity", "Q10_A_1", 1),
    ("Deprivation_Sensitivity", "Q10_A_2", 1),
    ("Deprivation_Sensitivity", "Q10_A_3", 1),
    ("Deprivation_Sensitivity", "Q10_A_4", 1),
    ("Deprivation_Sensitivity", "Q10_A_5", 1),
    ("Joyous_Exploration", "Q10_A_6", 1),
    ("Joyous_Exploration", "Q10_A_7", 1),
    ("Joyous_Exploration", "Q10_A_8", 1),
    ("Joyous_Exploration", "Q10_A_9", 1),
    ("Joyous_Exploration", "Q10_A_10", 1),
    ("Social_Curiosity", "Q10_A_11", 1),
    ("Social_Curiosity", "Q10_A_12", 1),
    ("Social_Curiosity", "Q10_A_13", 1),
    ("Social_Curiosity", "Q10_A_14", 1),
    ("Social_Curiosity", "Q10_A_15", 1),
    ("Stress_Tolerance", "Q10_A_16", -1),
    ("Stress_Tolerance", "Q10_A_17", -1),
    ("Stress_Tolerance", "Q10_A_18", -1),
    ("Stress_Tolerance", "Q10_A_19", -1),
    ("Stress_Tolerance", "Q10_A_20", -1),
    ("Thrill_Seeking", "Q10_A_21", 1),
    ("Thrill_Seeking", "Q10_A_22", 1),
    ("Thrill_Seeking", "Q10_A_23", 1),
    ("Thrill_Seeking", "Q10_A_24", 1),
    ("Thrill_Seeking", "Q10_A_25", 1),
    ("Interpersonal_Understanding", "Q11_A_1", 1),
    ("Interpersonal_Understanding", "Q11_A_2", 1),
    ("Interpersonal_Understanding", "Q11_A_3", 1),
    ("Self_Confidence", "Q11_A_4", 1),
    ("Self_Confidence", "Q11_A_5", 1),
    ("Self_Confidence", "Q11_A_6", 1),
    ("Self_Confidence", "Q11_A_7", 1),
    ("Suspension_Judgement", "Q11_A_8", 1),
    ("Suspension_Judgement", "Q11_A_9", 1),
    ("Suspension_Judgement", "Q11_A_10", 1),
    ("Suspension_Judgement", "Q11_A_11", 1),
    ("Suspension_Judgement", "Q11_A_12", 1),
    ("Self_Discipline", "Q12_A_1", 1),
    ("Self_Discipline", "Q12_A_2", 1),
    ("Self_Discipline", "Q12_A_3", 1),
    ("Self_Discipline", "Q12_A_4", 1),
    ("Industriness", "Q13_A_1", 1),
    ("Industriness", "Q13_A_2", 1),
    ("Industriness", "Q13_A_3", 1),
    ("Industriness", "Q13_A_4", 1),
    ("Industriness", "Q13_A_5", 1),
    ("Enthusiasm", "Q14_A_1", 1),
    ("Enthusiasm", "Q14_A_2", 1),
    ("Enthusiasm", "Q14_A_3", 1),
    ("Enthusiasm", "Q14_A_4", 1),
    ("Enthusiasm", "Q14_A_5", 1),
    ("Flow_Proneness", "Q15_A_1", 1),
    ("Flow_Proneness", "Q15_A_2", 1),
    ("Flow_Proneness", "Q15_A_3", 1),
    ("Flow_Proneness", "Q15_A_4", 1),
    ("Flow_Proneness", "Q15_A_5", 1),
    ("Flow_Proneness", "Q15_A_6", 1),
    ("Cyberwork_Confidence", "Q16_A_1", 1),
    ("Cyberwork_Confidence", "Q16_A_2", 1),
    ("Cyberwork_Confidence", "Q16_A_3", 1),
    ("Cyberwork_Confidence", "Q16_A_4", 1),
    ("Cyberwork_Confidence", "Q16_A_5", 1),
    ("Cyberwork_Confidence", "Q16_A_6", 1),
    ("General_SelfEfficacy", "Q17_A_1", 1),
    ("General_SelfEfficacy", "Q17_A_2", 1),
    ("General_SelfEfficacy", "Q17_A_3", 1),
    ("General_SelfEfficacy", "Q17_A_4", 1),
    ("General_SelfEfficacy", "Q17_A_5", 1),
    ("General_SelfEfficacy", "Q17_A_6", 1),
    ("General_SelfEfficacy", "Q17_A_7", 1),
    ("General_SelfEfficacy", "Q17_A_8", 1),
    ("Resilience", "Q18_A_1", 1),
    ("Resilience", "Q18_A_2", -1),
    ("Resilience", "Q18_A_3", 1),
    ("Resilience", "Q18_A_4", -1),
    ("Resilience", "Q18_A_5", 1),
    ("Resilience", "Q18_A_6", -1),
    ("Teamwork", "Q19_A_1", 1),
    ("Teamwork", "Q19_A_2", 1),
    ("Teamwork", "Q19_A_3", 1),
    ("Teamwork", "Q19_A_4", 1),
    ("Teamwork", "Q19_A_5", 1),
    ("Leadership", "Q20_A_1", 1),
    ("Leadership", "Q20_A_2", 1),
    ("Leadership", "Q20_A_3", 1),
    ("Leadership", "Q20_A_4", 1),
    ("Leadership", "Q20_A_5", 1),
    ("Leadership", "Q20_A_6", 1),
    ("Leadership", "Q20_A_7", 1),
    ("Intellectual_Openness", "Q22_A_1", 1),
    ("Intellectual_Openness", "Q22_A_2", 1),
    ("Intellectual_Openness", "Q22_A_3", 1),
    ("Intellectual_Openness", "Q22_A_4", 1),
    ("Intellectual_Openness", "Q22_A_5", 1),
    ("Intellectual_Openness", "Q22_A_6", 1),
    ("Intellectual_Openness", "Q22_A_7", -1),
    ("Intellectual_Openness", "Q22_A_8", -1),
    ("Intellectual_Openness", "Q22_A_9", -1),
    ("Intellectual_Openness", "Q22_A_10", -1),
    ("Tolerance", "Q21_A_1", -1),
    ("Tolerance", "Q21_A_2", 1),
    ("Tolerance", "Q21_A_3", -1),
    ("Tolerance", "Q21_A_4", 1),
    ("Tolerance", "Q21_A_5", -1),
    ("Tolerance", "Q21_A_6", 1),
    ("Tolerance", "Q21_A_7", -1),
    ("Tolerance", "Q21_A_8", 1),
    ("Tolerance", "Q21_A_9", -1),
    ("Tolerance", "Q21_A_10", 1),
    ("Tolerance", "Q21_A_11", -1),
    ("Tolerance", "Q21_A_12", 1),
    ("Tolerance", "Q21_A_13", -1),
    ("Tolerance", "Q21_A_14", 1),
    ("Tolerance", "Q21_A_15", -1),
    ("Tolerance", "Q21_A_16", 1),
]

# Questions of the twelve revised scales as (scale, item, sign).
REVISED_KEY = [
    ("Discipline", "Q8_A_3", 1),
    ("Discipline", "Q8_A_4", 1),
    ("Discipline", "Q8_A_5", 1),
    ("Discipline", "Q8_A_7", 1),
    ("Discipline", "Q8_A_9", 1),
    ("Discipline", "Q8_A_10", 1),
    ("Discipline", "Q12_A_2", 1),
    ("Discipline", "Q13_A_1", 1),
    ("Self_Consciousness", "Q1_A_1", 1),
    ("Self_Consciousness", "Q5_A_2", 1),
    ("Self_Consciousness", "Q6_A_5", 1),
    ("Self_Consciousness", "Q11_A_4", -1),
    ("Self_Consciousness", "Q11_A_5", -1),
    ("Self_Consciousness", "Q11_A_6", -1),
    ("Self_Consciousness", "Q12_A_3", 1),
    ("Self_Consciousness", "Q19_A_3", 1),
    ("Self_Efficacy", "Q17_A_3", 1),
    ("Self_Efficacy", "Q17_A_4", 1),
    ("Self_Efficacy", "Q17_A_5", 1),
    ("Self_Efficacy", "Q17_A_6", 1),
    ("Self_Efficacy", "Q17_A_7", 1),
    ("Self_Efficacy", "Q17_A_8", 1),
    ("Self_Efficacy", "Q20_A_2", 1),
    ("Self_Efficacy", "Q20_A_6", 1),
    ("Skill_Confidence", "Q9_A_1", -1),
    ("Skill_Confidence", "Q10_A_3", 1),
    ("Skill_Confidence", "Q15_A_2", 1),
    ("Skill_Confidence", "Q16_A_1", 1),
    ("Skill_Confidence", "Q16_A_2", 1),
    ("Skill_Confidence", "Q16_A_3", 1),
    ("Skill_Confidence", "Q16_A_4", 1),
    ("Skill_Confidence", "Q16_A_6", 1),
    ("Thrill_Seeking", "Q10_A_16", 1),
    ("Thrill_Seeking", "Q10_A_17", 1),
    ("Thrill_Seeking", "Q10_A_19", 1),
    ("Thrill_Seeking", "Q10_A_21", 1),
    ("Thrill_Seeking", "Q10_A_22", 1),
    ("Thrill_Seeking", "Q10_A_23", 1),
    ("Thrill_Seeking", "Q10_A_24", 1),
    ("Thrill_Seeking", "Q10_A_25", 1),
    ("Enthusiasm", "Q11_A_7", 1),
    ("Enthusiasm", "Q14_A_1", 1),
    ("Enthusiasm", "Q14_A_2", 1),
    ("Enthusiasm", "Q14_A_3", 1),
    ("Enthusiasm", "Q14_A_4", 1),
    ("Enthusiasm", "Q18_A_1", 1),
    ("Enthusiasm", "Q18_A_4", 1),
    ("Enthusiasm", "Q18_A_6", 1),
    ("Cognitive_Proficiency", "Q1_A_3", 1),
    ("Cognitive_Proficiency", "Q1_A_5", 1),
    ("Cognitive_Proficiency", "Q4_A_2", 1),
    ("Cognitive_Proficiency", "Q4_A_3", 1),
    ("Cognitive_Proficiency", "Q4_A_4", 1),
    ("Cognitive_Proficiency", "Q4_A_6", 1),
    ("Cognitive_Proficiency", "Q4_A_7", 1),
    ("Cognitive_Proficiency", "Q7_A_12", 1),
    ("Social_Curiosity", "Q10_A_11", 1),
    ("Social_Curiosity", "Q10_A_12", 1),
    ("Social_Curiosity", "Q10_A_13", 1),
    ("Social_Curiosity", "Q10_A_14", 1),
    ("Social_Curiosity", "Q10_A_15", 1),
    ("Social_Curiosity", "Q11_A_1", 1),
    ("Social_Curiosity", "Q11_A_2", 1),
    ("Social_Curiosity", "Q11_A_3", 1),
    ("Intellectual_Curiosity", "Q4_A_5", 1),
    ("Intellectual_Curiosity", "Q5_A_1", 1),
    ("Intellectual_Curiosity", "Q5_A_4", 1),
    ("Intellectual_Curiosity", "Q6_A_1", 1),
    ("Intellectual_Curiosity", "Q10_A_4", 1),
    ("Intellectual_Curiosity", "Q10_A_8", 1),
    ("Intellectual_Curiosity", "Q10_A_9", 1),
    ("Intellectual_Curiosity", "Q22_A_6", 1),
    ("Analytical", "Q9_A_4", 1),
    ("Analytical", "Q9_A_5", 1),
    ("Analytical", "Q10_A_1", 1),
    ("Analytical", "Q11_A_9", 1),
    ("Analytical", "Q11_A_10", 1),
    ("Analytical", "Q11_A_11", 1),
    ("Analytical", "Q11_A_12", 1),
    ("Analytical", "Q13_A_5", 1),
    ("Creativity", "Q7_A_1", 1),
    ("Creativity", "Q7_A_2", 1),
    ("Creativity", "Q7_A_5", 1),
    ("Creativity", "Q7_A_7", 1),
    ("Creativity", "Q7_A_9", 1),
    ("Creativity", "Q7_A_10", 1),
    ("Creativity", "Q7_A_11", 1),
    ("Creativity", "Q7_A_13", 1),
    ("Openness", "Q6_A_2", 1),
    ("Openness", "Q6_A_3", 1),
    ("Openness", "Q6_A_6", 1),
    ("Openness", "Q19_A_2", 1),
    ("Openness", "Q20_A_5", 1),
    ("Openness", "Q20_A_7", 1),
    ("Openness", "Q22_A_2", 1),
    ("Openness", "Q22_A_4", 1),
]

REVERSED_ITEMS = [item for _, item, sign in SCALE_KEY if sign < 0]

# Published mean share correct per cognitive test type.
NORMS = [("ThreeD", 0.23), ("Pattern", 0.46), ("Matrix", 0.44), ("Verbal", 0.57), ("Analogies", 0.37)]

# Text replacements, applied in order, by column.
RECODES = {
    "Rank": [("E1 - E9", "Enlisted"), ("O1 or higher", "Officer"), ("WO1 - CW5", "Warrant")],
    "Degree": [
        (r"Bachelor's Degree \(4 year\)", "Bachelors"),
        ("Master's Degree or higher", "Masters"),
        ("Some college or university but did not graduate", "Some College"),
        ("High School Graduate", "High School"),
        (r"Associate Degree \(2 year\)", "Associates"),
    ],
    "Experience": [("6 years or more", ">5Years"), ("5 years or less", "<=5Years")],
    "GTScore": [
        ("121 or higher", ">120"),
        ("120 or lower", "<=120"),
        ("N/A or prefer not to report", "not reported"),
    ],
    "Work_Role": [
        ("Tier-1 - Remote Operator", "Tier1_RO"),
        ("Tier-1 - Capability Developer", "Tier1_CD"),
        ("Tier-1 - Exploitation Analyst", "Tier1_EA"),
        (r"Tier 2- Data Architect, Network Analyst, System Analyst \(All Master Proficiency level only\)", "Tier_2"),
        ("Tier 3- Other work role directly assigned to a Cyber Mission Force Team", "Tier_3"),
        ("Tier 4 -  Other authorized cyber work role", "Tier_4"),
        ("I am currently not assigned a cyber work role or I am assigned as a student", "Tier_Other"),
    ],
}


def scale_key_rows() -> list[tuple[str, str, int]]:
    """(scale, item, sign) for the 27 scales."""
    return list(SCALE_KEY)


def cognitive_key_rows() -> list[tuple[str, str, int]]:
    """(test type, item, 1); the type is the item's own prefix, 3D being ThreeD."""
    names = {"3D": "ThreeD"}
    return [(names.get(item.split("_")[0], item.split("_")[0]), item, 1) for item, _ in ANSWER_KEY]


def revised_key_rows() -> list[tuple[str, str, int]]:
    return list(REVISED_KEY)


def key_frame(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "scale string, item string, sign int")
