"""Analogy file parsing and evaluation on small hand-made vocabularies."""

from wordpair.operators.analogy import analogy_topk, evaluate_analogies
from wordpair.sources.analogies import parse_analogies, read_analogy_lines

# boat - sail + wheel points along cart; the others point elsewhere
TOY = {"sail": [0, 2, 1, 0], "boat": [0, 2, 1, 3], "wheel": [1, -1, 2, 0], "cart": [2, -2, 4, 6],
       "fog": [-3, 0, 0, -1], "hill": [0, 0, -2, 1], "lamp": [1, 5, 0, 0]}


def _vectors(spark, vecs):
    return spark.createDataFrame([(i + 1, w, 1, [float(x) for x in v]) for i, (w, v) in enumerate(vecs.items())],
                                 "id int, word string, count long, v array<float>")


def _questions(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "qid long, relation string, a string, b string, c string, d string")


def test_parse_file(spark, tmp_path):
    p = tmp_path / "q.txt"
    p.write_text(": young\ncow calf hen chick\n\ncow calf pig piglet\n: tool\n\nsaw wood axe log\n")
    rows = parse_analogies(read_analogy_lines(spark, str(p))).orderBy("line_no").collect()
    assert [(r.relation, r.a, r.d) for r in rows] == \
        [("young", "cow", "chick"), ("young", "cow", "piglet"), ("tool", "saw", "log")]


def test_headers_carry_over_partitions(spark):
    lines = [("f", 0, "p q r s")] + [("f", 10 * k, f": rel{k}") for k in range(1, 4)]
    lines += [("f", 10 * k + j, f"a{j} b c d") for k in range(1, 4) for j in range(1, 10)]
    lines += [("g", j, "a b c d") for j in range(5)]
    df = spark.createDataFrame(lines, "file string, line_no long, value string").repartition(7)
    got = {(r.file, r.line_no): r.relation for r in parse_analogies(df).collect()}
    assert got == {(f, n): ("" if f == "g" or n == 0 else f"rel{n // 10}")
                   for f, n, v in lines if not v.startswith(":")}


def test_parse_edge_lines(spark):
    lines = spark.createDataFrame(
        [("f", 0, "x y z w"), ("f", 1, "  :  rel one  "), ("f", 2, "a b c"), ("f", 3, "\ta\tb c  d "),
         ("f", 4, "a b c d e"), ("g", 0, ": other"), ("g", 1, "p q r s")],
        "file string, line_no long, value string")
    got = [(r.file, r.relation, r.a, r.d) for r in parse_analogies(lines).orderBy("file", "line_no").collect()]
    assert got == [("f", "", "x", "w"), ("f", "rel one", "a", "d"), ("g", "other", "p", "s")]


def test_toy_analogy_found(spark):
    pred, by_rel, summary = evaluate_analogies(_vectors(spark, TOY), _questions(spark, [("move", "sail", "boat", "wheel", "cart")]),
                                               lowercase=False)
    s = summary.first()
    assert (s.n_eligible, s.overall, s.n_total) == (1, 1.0, 1)
    assert pred.first().pred == 4
    assert [(r.relation, r.correct, r.total) for r in by_rel.collect()] == [("move", 1, 1)]
    top = analogy_topk(_vectors(spark, TOY), _questions(spark, [("move", "sail", "boat", "wheel", "cart")]), 3)
    rows = sorted((r.rank, r.id) for r in top.collect())
    assert rows[0] == (1, 4) and len(rows) == 3 and not {1, 2, 3} & {i for _, i in rows}


def test_nan_never_wins_ties_lowest_id_and_no_candidate(spark):
    vecs = dict(TOY)
    vecs["void"] = [0.0] * 4             # zero vector: NaN cosine, must lose
    vecs["wagon"] = [2, -2, 4, 6]        # equal to cart: the tie goes to the lower id
    qs = [("move", "sail", "boat", "wheel", "cart"), ("move", "SAIL", "Boat", "wheeL", "CART"),
          ("x", "sail", "boat", "raft", "cart")]
    pred, _, summary = evaluate_analogies(_vectors(spark, vecs), _questions(spark, qs), lowercase=True)
    got = {r.qid: r.pred for r in pred.collect()}
    assert got == {0: 4, 1: 4}
    s = summary.first()
    assert (s.n_eligible, s.n_total, s.n_correct) == (2, 3, 2)


def test_three_word_vocabulary_has_no_candidate(spark):
    vecs = {"x": [3, 1], "y": [-1, 2], "u": [1, 4]}
    pred, _, summary = evaluate_analogies(_vectors(spark, vecs), _questions(spark, [("r", "x", "y", "u", "u")]))
    r = pred.first()
    assert r.pred == 0 and not r.correct
    assert summary.first().overall == 0.0


def test_normalize_works_out_its_vector_once(spark):
    """The norm of a computed vector is no part of the lambda over components."""
    from wordpair.functions.vec import normalize, vadd
    df = spark.createDataFrame([(1, [3.0, 4.0], [0.0, 0.0]), (2, [0.0], [0.0]), (3, None, [1.0])],
                               "id int, a array<double>, b array<double>")
    out = df.select("id", normalize(vadd("a", "b")).alias("n"))
    got = {r["id"]: r["n"] for r in out.collect()}
    assert got[1] == [0.6, 0.8] and got[2][0] != got[2][0] and got[3] is None
    assert out._jdf.queryExecution().analyzed().toString().count("zip_with") == 1
