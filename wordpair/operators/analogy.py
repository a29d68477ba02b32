"""Analogy test  a : b :: c : ?  by cosine argmax over the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordpair.functions.vec import normalize, vadd, vsub
from wordpair.operators.scoring import TopK, one_sided


def eligible_questions(vectors: DataFrame, questions: DataFrame, lowercase: bool = True) -> DataFrame:
    """Questions with all four words in the vocabulary, with their ids.

    ``lowercase`` lowers the question words only, not the vocabulary."""
    key = (lambda c: F.lower(F.col(c))) if lowercase else (lambda c: F.col(c))
    ids = vectors.select("word", "id")
    q = questions.select("qid", "relation", *[key(c).alias(c) for c in "abcd"])
    for c in "abcd":
        q = q.join(ids.select(F.col("word").alias(c), F.col("id").alias(f"{c}_id")), c)
    return q


#: Ids that a question's answer cannot be.
ASKED = ("a_id", "b_id", "c_id")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", normalize("v").alias("vn"))


def targets(vectors: DataFrame, eligible: DataFrame) -> DataFrame:
    """``(qid, a_id, b_id, c_id, qn)``: the direction v_b - v_a + v_c of each question."""
    v = vectors.select("id", "v")
    va, vb, vc = (v.select(F.col("id").alias(f"{c}_id"), F.col("v").alias(f"v{c}")) for c in "abc")
    return (eligible.join(va, "a_id").join(vb, "b_id").join(vc, "c_id")
            .select("qid", *ASKED, normalize(vadd(vsub("vb", "va"), "vc")).alias("qn")))


def analogy_predictions(vectors: DataFrame, questions: DataFrame, lowercase: bool = True) -> DataFrame:
    """``(qid, relation, a_id, b_id, c_id, d_id, pred, score, correct)`` per
    eligible question.  pred = argmax over words other than a, b, c of
    cos(v_w, v_b - v_a + v_c); NaN never wins, ties go to the lowest id, and
    a question with no candidate gets pred 0 (counted wrong)."""
    el = eligible_questions(vectors, questions, lowercase)
    best = one_sided(unit_vectors(vectors), targets(vectors, el), lambda block: TopK(block, 1, ASKED), TopK.schema,
                     "analogies", vcol="vn", qcol="qn")
    top = (best.groupBy("qid")
               .agg(F.max(F.struct(F.col("score"), (-F.col("id")).alias("neg"))).alias("b"))
               .select("qid", (-F.col("b.neg")).cast("int").alias("pred"), F.col("b.score").alias("score")))
    out = el.join(top, "qid", "left")
    return out.select("qid", "relation", "a_id", "b_id", "c_id", "d_id",
                      F.coalesce("pred", F.lit(0)).cast("int").alias("pred"), "score",
                      (F.coalesce("pred", F.lit(0)) == F.col("d_id")).alias("correct"))


def analogy_topk(vectors: DataFrame, questions: DataFrame, k: int = 5,
                 lowercase: bool = True) -> DataFrame:
    """T3 in general form: ``(qid, rank, id, score)``, the k words of highest cosine
    per eligible question, the question's own a, b, c excluded; NaN never ranks,
    ties go to the lowest id.  At most k rows per question and task are shuffled."""
    el = eligible_questions(vectors, questions, lowercase)
    best = one_sided(unit_vectors(vectors), targets(vectors, el), lambda block: TopK(block, k, ASKED), TopK.schema,
                     "analogies", vcol="vn", qcol="qn")
    return ranked(best, k)


def ranked(best: DataFrame, k: int) -> DataFrame:
    """The k best of each query's candidates (at most k a task)."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").asc())
    return (best.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
                .select("qid", "rank", "id", "score"))


def accuracy_report(by_relation: DataFrame) -> DataFrame:
    """The by-relation table in order of the relation's name."""
    return by_relation.orderBy("relation")


def accuracy_by_relation(pred: DataFrame) -> DataFrame:
    """``(relation, correct, total, accuracy)`` over eligible questions."""
    return (pred.groupBy("relation")
                .agg(F.sum(F.col("correct").cast("long")).alias("correct"),
                     F.count(F.lit(1)).alias("total"))
                .withColumn("accuracy", F.col("correct") / F.col("total")))


def accuracy_summary(pred: DataFrame, questions: DataFrame) -> DataFrame:
    """A18 + A19: ``(overall, n_correct, n_eligible, n_total, n_relations)``;
    overall is 0.0 when nothing is eligible."""
    p = pred.agg(F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("n_correct"),
                 F.count(F.lit(1)).alias("n_eligible"))
    n_total = questions.agg(F.count(F.lit(1))).scalar()
    n_rel = questions.agg(F.countDistinct("relation")).scalar()
    return p.select(F.when(F.col("n_eligible") > 0, F.col("n_correct") / F.col("n_eligible"))
                    .otherwise(F.lit(0.0)).alias("overall"),
                    "n_correct", "n_eligible", n_total.alias("n_total"), n_rel.alias("n_relations"))


def evaluate_analogies(vectors: DataFrame, questions: DataFrame, lowercase: bool = True):
    """``(predictions, by_relation, summary)``."""
    pred = analogy_predictions(vectors, questions, lowercase)
    return pred, accuracy_by_relation(pred), accuracy_summary(pred, questions)
