"""Neighbours, clusters, classifiers and the two ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.functions.text import remove_first
from locigrid.operators import aggregate as agg
from locigrid.operators import classify, clustering, features, hierarchy, inverted, neighbours, sampling, scoring, shape
from locigrid.operators.scans import ordered_index
from locigrid.plans.catalog import query
from locigrid.plans.standins import embeddings, hash_share, hash_share_sql, r6, table, text_of
from locigrid.session import cut_lineage

VECTORS = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, CAST(label AS VARCHAR) AS label FROM embeddings)"
# Rows without a bin, by hash.
FREE_SHARE = 0.3
FREE = f"{hash_share_sql('free', 'id')} < {FREE_SHARE}"


def binned_and_free(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = embeddings(spark, sf_dir)
    free = hash_share("free", "id") < FREE_SHARE
    return rows.filter(~free), rows.filter(free)


@query(
    "M22",
    f"""WITH {VECTORS}, d AS (SELECT a.id, b.id AS neighbour, pow(list_sum(list_transform(range(1, 65), lambda i: pow(abs(a.f[i] - b.f[i]), 3))), 1.0::DOUBLE / 3) AS distance
          FROM e a, e b WHERE a.id <> b.id)
        SELECT id, neighbour, round(distance, 6) AS distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d) WHERE rank <= 10""",
)
def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest other rows of every row, Minkowski distance of order 3."""
    edges = neighbours.knn_graph(embeddings(spark, sf_dir).select("id", "features"), 10, 3.0)
    return edges.withColumn("distance", r6(F.col("distance")))


@query("M22 M16", "SELECT count(*) AS rows, true AS recalled, true AS few_compared FROM embeddings")
def neighbours_by_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest other rows of every row by inverted lists, held against the exact ones.

    ``recalled``: nine of ten exact neighbours are found; ``few_compared``: a
    query's short list is under a tenth of the rows (tiny tables aside).
    """
    rows = cut_lineage(embeddings(spark, sf_dir).select("id", "features"))
    n = rows.count()
    found = inverted.nearest_by_codes(rows, rows, 11, 3.0, SHORTLIST)
    exact = neighbours.nearest(rows, rows, 11, 3.0)
    share = inverted.recall(found, exact)
    return rows.agg(
        F.count("*").alias("rows"), F.lit(share >= 0.9).alias("recalled"), F.lit(SHORTLIST * 10 < n or n < 1_000).alias("few_compared")
    )


# Rows compared exactly per query.
SHORTLIST = 40

KNN = f"""{VECTORS}, n AS (SELECT q.id, t.label AS class, list_distance(q.f, t.f) AS distance,
    row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.f, t.f), t.id) AS rank FROM (SELECT * FROM e WHERE {FREE}) q, (SELECT * FROM e WHERE NOT {FREE}) t)"""


@query(
    "M16",
    f"WITH {KNN} SELECT id, class, round(count(*) / 3.0::DOUBLE, 6) AS prob FROM n WHERE rank <= 3 GROUP BY 1, 2",
)
def neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote shares of the three nearest binned rows."""
    binned, free = binned_and_free(spark, sf_dir)
    return neighbours.knn_classify(binned, free, 3).withColumn("prob", r6(F.col("prob")))


@query(
    "M16 J09",
    f"""WITH {KNN}, w AS (SELECT id, class, sum(1 / distance) AS s FROM n WHERE rank <= 5 GROUP BY 1, 2), p AS (SELECT id, class, s / sum(s) OVER (PARTITION BY id) AS prob FROM w)
        SELECT id, min(class) AS pred, round(max(prob), 6) AS prob FROM (SELECT *, max(prob) OVER (PARTITION BY id) AS m FROM p) WHERE prob >= m - 0.000000000001 GROUP BY id""",
)
def weighted_neighbour_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best class by inverse distance over the five nearest binned rows."""
    binned, free = binned_and_free(spark, sf_dir)
    best = neighbours.best_class(neighbours.knn_classify(binned, free, 5, weighted=True))
    return best.withColumn("prob", r6(F.col("prob")))


EPS = 1.2


def _density_sql(weight: str, minimum: str) -> str:
    """Core rows, their components and the nearest core row of the others."""
    return f"""{VECTORS}, w AS (SELECT *, {weight} AS w FROM e), d AS (SELECT a.id, b.id AS other, b.w, list_distance(a.f, b.f) AS distance FROM w a, w b WHERE list_distance(a.f, b.f) <= {EPS}),
      core AS (SELECT id FROM d GROUP BY 1 HAVING sum(w) >= {minimum}), link AS (SELECT id, other, distance FROM d WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
      reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.other, r.root FROM reach r JOIN link l ON l.id = r.id),
      comp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1)"""


@query(
    "M11",
    f"""WITH RECURSIVE {_density_sql("log10(20000 + 1000 * (id % 7))", "22")}, edge AS (SELECT id, first(other ORDER BY distance, other) AS c FROM d WHERE id NOT IN (SELECT id FROM core) AND other IN (SELECT id FROM core) GROUP BY 1)
        SELECT e.id, CAST(coalesce(comp.cluster, ec.cluster, -1) AS BIGINT) AS cluster FROM e LEFT JOIN comp ON comp.id = e.id LEFT JOIN edge ON edge.id = e.id LEFT JOIN comp ec ON ec.id = edge.c""",
)
def weighted_density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters with a weight per row, border rows included."""
    rows = embeddings(spark, sf_dir).withColumn("w", F.log10(20_000 + 1_000 * (F.col("id") % 7)))
    return neighbours.dbscan(rows, EPS, 22.0, "w")


@query(
    "M10",
    f"""WITH RECURSIVE {_density_sql("1", "5")}, big AS (SELECT cluster FROM comp GROUP BY 1 HAVING count(*) >= 3)
        SELECT e.id, CAST(CASE WHEN cluster IN (SELECT cluster FROM big) THEN cluster ELSE -1 END AS BIGINT) AS cluster FROM e LEFT JOIN comp USING (id)""",
)
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters at a given cut, small ones and border rows as noise."""
    rows = embeddings(spark, sf_dir).select("id", "features")
    return neighbours.density_labels(rows, min_samples=5, min_cluster_size=3, cut=EPS)


@query("M10")
def hierarchy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters chosen from the hierarchy, without a distance given."""
    return hierarchy.hierarchy_labels(embeddings(spark, sf_dir).select("id", "features"), 5, 5)


LEVELS = [0.9, 1.0, 1.1, 1.2, 1.3]


@query(
    "M10",
    f"""WITH RECURSIVE {VECTORS}, d AS (SELECT a.id, b.id AS other, list_distance(a.f, b.f) AS d FROM e a, e b),
      core AS (SELECT id, d AS core FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS n FROM d) WHERE n = 6),
      m AS (SELECT d.id, d.other, greatest(d.d, x.core, y.core) AS h FROM d JOIN core x USING (id) JOIN core y ON y.id = d.other WHERE d.id <> d.other),
      l(level) AS (SELECT unnest({LEVELS})::DOUBLE), reach(level, id, root) AS (SELECT level, id, id FROM l, e UNION SELECT r.level, m.other, r.root FROM reach r JOIN m ON m.id = r.id AND m.h <= r.level),
      low AS (SELECT level, id, min(root) AS root FROM reach GROUP BY 1, 2)
      SELECT level, count(DISTINCT root) AS groups FROM low GROUP BY 1""",
)
def density_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into how many groups mutual reachability parts the rows at several heights, read off the spanning tree."""
    points = embeddings(spark, sf_dir).select("id", "features")
    _, leaves, seen = hierarchy.density_leaves(points, 5)
    tree = hierarchy.spanning_tree(leaves, seen)
    heights = tree.withColumn("level", F.explode(F.lit(LEVELS)))
    joined = heights.groupBy("level").agg(F.count_if(F.col("height") <= F.col("level")).alias("edges"), F.count("*").alias("all"))
    return joined.select("level", (F.col("all") + 1 - F.col("edges")).alias("groups"))


def _reduced(rows: DataFrame, share: float = 0.90) -> DataFrame:
    scaled = features.Standardiser.fit(rows).apply(rows)
    return features.Components.fit(scaled, share).apply(scaled)


@query("M05 M04")
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components up to ninety percent of the variance, in long form."""
    out = _reduced(embeddings(spark, sf_dir).select("id", "features"))
    return out.select("id", F.posexplode("features").alias("component", "value"))


@query(
    "M05 M04",
    """WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings), s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY 1)
       SELECT id, round(sum(((x - m) / sd) ** 2), 4) AS norm FROM x JOIN s USING (dim) GROUP BY id""",
)
def component_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length of every row in all its components, which is that of its standardised numbers."""
    out = _reduced(embeddings(spark, sf_dir).select("id", "features"), 0.9999999)
    return out.select("id", F.round(F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v * v), 4).alias("norm"))


@query(
    "M06 M07 M09 M05",
    "SELECT method, count(*) AS rows, true AS within_k, true AS better_than_chance FROM embeddings, (VALUES ('kmeans'), ('mixture'), ('ward')) AS m(method) GROUP BY method",
)
def cluster_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of any good labels, whatever their names: every row has one of at most ten, and the means of the
    clusters explain at least three times the spread that labels drawn by chance would."""
    points = cut_lineage(_reduced(embeddings(spark, sf_dir)))
    makers = {"kmeans": clustering.kmeans_labels, "mixture": clustering.gmm_labels, "ward": clustering.ward_labels}
    labels = shape.union_strict(*[make(points, 10).withColumn("method", F.lit(name)) for name, make in makers.items()])
    cells = cut_lineage(labels).join(points, "id").select("method", "cluster", "id", F.posexplode("features").alias("j", "v"))
    # numbers of the components have mean 0, so their squares are the spread
    sums = cells.groupBy("method", "cluster", "j").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    per = sums.groupBy("method").agg(
        F.sum(F.when(F.col("j") == 0, F.col("n"))).alias("rows"), F.count_distinct("cluster").alias("k"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("q").alias("all"),
    )
    chance = (F.col("k") - 1) / (F.col("rows") - 1)
    return per.select("method", "rows", (F.col("k") <= 10).alias("within_k"), (F.col("between") / F.col("all") > 3 * chance).alias("better_than_chance"))


@query("M08 M22", "SELECT count(*) AS rows, true AS within_k, true AS better_than_chance FROM embeddings")
def spectral_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral labels join neighbours: a larger share of the graph's edges lies inside clusters than their sizes alone would give."""
    points = cut_lineage(_reduced(embeddings(spark, sf_dir)).select("id", "features"))
    labels = cut_lineage(clustering.spectral_labels(points, 10))
    edges = neighbours.knn_graph(points, 10, 2.0).join(labels, "id")
    other = labels.select(F.col("id").alias("neighbour"), F.col("cluster").alias("theirs"))
    inside = edges.join(other, "neighbour").agg(F.avg((F.col("cluster") == F.col("theirs")).cast("double")).alias("inside"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    chance = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("chance"))
    both = chance.withColumn("inside", inside.scalar())
    return both.select("rows", (F.col("k") <= 10).alias("within_k"), (F.col("inside") > F.col("chance")).alias("better_than_chance"))


@query("M06")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans_labels(_reduced(embeddings(spark, sf_dir)), 10)


@query("M07 M05")
def mixture_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian mixture on the leading components."""
    return clustering.gmm_labels(_reduced(embeddings(spark, sf_dir)), 10)


@query("M08 M22")
def spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.spectral_labels(_reduced(embeddings(spark, sf_dir)), 10)


@query("M09")
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.ward_labels(_reduced(embeddings(spark, sf_dir)), 10)


@query("M15")
def discriminant_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned, free = binned_and_free(spark, sf_dir)
    return classify.LinearDiscriminant.fit(binned).probabilities(free)


@query("M17")
def forest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned, free = binned_and_free(spark, sf_dir)
    return classify.random_forest(binned, free)


@query("M18")
def rbf_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned, free = binned_and_free(spark, sf_dir)
    return classify.rbf_machine(binned, free)


NEIGHBOUR_GRID = {"k": [3, 5, 7, 9], "weights": ["uniform", "distance"]}
FOLD = "CAST(CAST('0x' || substr(md5('42|fold|' || id), 1, 8) AS BIGINT) % 5 AS INTEGER)"
NEIGHBOUR_SETTINGS = ", ".join(f"({s['k']}, '{s['weights']}')" for s in classify.pick_settings(NEIGHBOUR_GRID, 5, 42))


@query(
    "M21 M16",
    f"""WITH {VECTORS}, r AS (SELECT *, {FOLD} AS fold FROM e), s(k, weights) AS (VALUES {NEIGHBOUR_SETTINGS}),
      d AS (SELECT q.id, q.fold, q.label AS truth, t.id AS near, t.label AS class, list_distance(q.f, t.f) AS d FROM r q JOIN r t ON q.fold <> t.fold),
      n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, near) AS rank, min(d) OVER (PARTITION BY id) AS least FROM d),
      v AS (SELECT k, weights, fold, id, truth, class, sum(CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE WHEN least = 0 THEN CAST(d = 0 AS DOUBLE) ELSE 1 / d END) AS v
        FROM n JOIN s ON rank <= k GROUP BY ALL),
      b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k, weights, id ORDER BY v DESC, class) = 1),
      a AS (SELECT k, weights, fold, avg(CAST(class = truth AS DOUBLE)) AS accuracy FROM b GROUP BY ALL)
      SELECT k, weights, round(avg(accuracy), 6) AS accuracy FROM a GROUP BY ALL""",
)
def neighbour_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated accuracy of five random neighbour settings."""
    return classify.search_knn(embeddings(spark, sf_dir), NEIGHBOUR_GRID).withColumn("accuracy", r6(F.col("accuracy")))


# The method's lists of settings.
FOREST_GRID = {
    "trees": [100, 200, 300, 400],
    "criterion": ["gini", "entropy"],
    "depth": [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, None],
    "split": [2, 5, 10],
    "leaf": [1, 2, 4],
    "features": ["sqrt", "log2", "all"],
}
DISCRIMINANT_GRID = {"solver": ["svd", "lsqr", "eigen"], "n_components": [2, 3, 4, 5]}


@query("M21 M17")
def forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated accuracy of five random forest settings."""
    return classify.search_forest(embeddings(spark, sf_dir), FOREST_GRID)


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to their first two numbers, for which the discriminant has a closed form."""
    return embeddings(spark, sf_dir).withColumn("features", F.slice("features", 1, 2))


def _plane_sql(rows: str, part: str, divisor: str) -> str:
    """Weights and offset of every class by ``part``; the pooled scatter is a matrix of two by two."""
    return f"""k AS (SELECT {part}, label, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb FROM {rows} GROUP BY ALL),
      s AS (SELECT {part}, sum((a - ma) ** 2) AS saa, sum((a - ma) * (b - mb)) AS sab, sum((b - mb) ** 2) AS sbb, count(*)::DOUBLE AS n, count(DISTINCT label) AS c FROM {rows} JOIN k USING ({part}, label) GROUP BY ALL),
      i AS (SELECT {part}, n AS total, ({divisor}) * sbb / (saa * sbb - sab ** 2) AS iaa, -({divisor}) * sab / (saa * sbb - sab ** 2) AS iab, ({divisor}) * saa / (saa * sbb - sab ** 2) AS ibb FROM s),
      w AS (SELECT {part}, label, ma * iaa + mb * iab AS wa, ma * iab + mb * ibb AS wb, -0.5 * (ma ** 2 * iaa + 2 * ma * mb * iab + mb ** 2 * ibb) + ln(k.n / total) AS w0 FROM k JOIN i USING ({part}))"""


PLANE = "p AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)"


@query(
    "M17 M18 M15",
    f"""WITH {VECTORS}, c AS (SELECT count(DISTINCT label) AS c FROM e WHERE NOT {FREE})
      SELECT method, count(*) AS rows, min(c) AS classes, true AS sums_to_one, true AS better_than_chance FROM e, c, (VALUES ('forest'), ('machine'), ('discriminant')) AS m(method) WHERE NOT {FREE} GROUP BY method""",
)
def classifier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three classifiers asked about the rows they learned from: a probability of every class for every row, which
    sum to one, and more hits than chance would give. The labels of other rows do not follow from these vectors."""
    binned = cut_lineage(binned_and_free(spark, sf_dir)[0])
    found = {
        "forest": classify.random_forest(binned, binned, trees=30),
        "machine": classify.rbf_machine(binned, binned, size=64, rounds=8),
        "discriminant": classify.LinearDiscriminant.fit(binned).probabilities(binned),
    }
    every = cut_lineage(shape.union_strict(*[df.select("id", "class", "prob").withColumn("method", F.lit(m)) for m, df in found.items()]))
    best = F.max_by("class", F.struct("prob", "class")).alias("class")
    rows = every.groupBy("method", "id").agg(F.sum("prob").alias("p"), F.count_distinct("class").alias("classes"), best)
    rows = rows.join(binned.select("id", "label"), "id")
    return rows.groupBy("method").agg(
        F.count("*").alias("rows"), F.min("classes").alias("classes"), (F.max(F.abs(F.col("p") - 1)) < 1e-6).alias("sums_to_one"),
        (F.avg((F.col("class") == F.col("label")).cast("double")) > 1.0 / F.min("classes")).alias("better_than_chance"),
    )


@query(
    "M15",
    f"""WITH {PLANE}, t AS (SELECT 0 AS g, * FROM p WHERE NOT {FREE}), {_plane_sql("t", "g", "n - c")},
          z AS (SELECT id, w.label AS class, exp(a * wa + b * wb + w0) AS e FROM (SELECT * FROM p WHERE {FREE}) q, w)
        SELECT id, class, round(e / sum(e) OVER (PARTITION BY id), 6) AS prob FROM z""",
)
def discriminant_in_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities by the first two numbers of the vectors."""
    rows = plane(spark, sf_dir)
    free = hash_share("free", "id") < FREE_SHARE
    model = classify.LinearDiscriminant.fit(rows.filter(~free))
    return model.probabilities(rows.filter(free)).withColumn("prob", r6(F.col("prob")))


def _search_sql() -> str:
    """Accuracy of the drawn settings: refitted for every fold, which the one pass must equal."""
    settings = classify.pick_settings(DISCRIMINANT_GRID, 5, 42)
    parts = [f"""WITH {PLANE}, r AS (SELECT *, {FOLD} AS fold FROM p), t AS (SELECT g, r.* FROM r, range(5) AS x(g) WHERE fold <> g)"""]
    both = {"svd": "n - c", "biased": "n"}
    for kind, divisor in both.items():
        inner = _plane_sql("t", "g", divisor).replace("k AS (", f"k_{kind} AS (", 1)
        for name in ("s", "i", "w"):
            inner = inner.replace(f" {name} AS (SELECT", f" {name}_{kind} AS (SELECT")
        inner = inner.replace("JOIN k USING", f"JOIN k_{kind} AS k USING").replace("FROM s)", f"FROM s_{kind})").replace("FROM k JOIN i", f"FROM k_{kind} AS k JOIN i_{kind} AS i")
        parts.append(f""", {inner}, hit_{kind} AS (SELECT fold, avg(CAST(label = pred AS DOUBLE)) AS accuracy FROM (SELECT r.id, r.fold, r.label,
            max_by(w.label, r.a * wa + r.b * wb + w0) AS pred FROM r JOIN w_{kind} AS w ON w.g = r.fold GROUP BY ALL) GROUP BY fold)""")
    rows = [
        f"SELECT '{', '.join(f'{k}={v}' for k, v in sorted(s.items()))}' AS setting, round(avg(accuracy), 6) AS accuracy FROM hit_{'svd' if s['solver'] == 'svd' else 'biased'}"
        for s in settings
    ]
    return "".join(parts) + " " + " UNION ALL ".join(rows)


@query("M21 M15", _search_sql())
def discriminant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated accuracy of five random discriminant settings, on the first two numbers of the vectors."""
    found = classify.search_discriminant(plane(spark, sf_dir), DISCRIMINANT_GRID)
    return found.withColumn("accuracy", r6(F.col("accuracy")))


def letter_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every letter in a document: contig = document, bin = language, motif = letter."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    letter = F.explode(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ""), lambda x: x != ""))
    counts = docs.select(text_of("doc_id").alias("contig"), F.col("lang").alias("bin"), letter.alias("motif"))
    counts = counts.groupBy("contig", "bin", "motif").agg(F.count("*").alias("n"))
    totals = counts.groupBy("contig").agg(F.sum("n").alias("length"))
    return counts.join(totals, "contig").withColumn("x", F.col("n") / F.col("length"))


@query("M01 M03 M04 M05 M06 M07 M08 M09 M10 M12 M13 A26 A27 R04")
def contamination_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs that three or more of five clusterings place outside the home cluster of their bin.

    Every bin first receives one contig of another bin.
    """
    shares = cut_lineage(letter_shares(spark, sf_dir))
    pairs = shares.select("contig", "bin").distinct()
    mixed, _ = sampling.inject_foreign(pairs, pairs, 1)
    mixed = mixed.select(F.col("contig").alias("name"), remove_first(F.col("contig"), "contamination_").alias("contig"), "bin")
    rows = shares.drop("bin").join(mixed, "contig").drop("contig").withColumnRenamed("name", "contig")
    sizes = cut_lineage(rows.select("contig", "length").distinct())
    index = cut_lineage(features.feature_index(rows, "motif"))
    vectors = features.impute_within(rows, "motif", "x", index)
    numbered = cut_lineage(ordered_index(vectors, ["contig"], "id"))
    points = cut_lineage(_reduced(numbered.select("id", "features")))
    k = numbered.select("bin").distinct().count()
    labels = {
        "kmeans": clustering.kmeans_labels(points, k),
        "gmm": clustering.gmm_labels(points, k),
        "spectral": clustering.spectral_labels(points, k),
        "agg": clustering.ward_labels(points, k),
        "dscan": hierarchy.hierarchy_labels(points, 3, 2),
    }
    results = shape.union_strict(*[df.withColumn("method", F.lit(m)) for m, df in labels.items()])
    results = cut_lineage(results.join(numbered.select("id", "contig", "bin"), "id").drop("id"))
    bins = agg.bin_sizes(numbered.select("contig", "bin"), sizes)
    homes = scoring.home_cluster(agg.cluster_sizes(results, sizes, bins))
    return scoring.flag_foreign(results, homes, 3, at_least=True)


@query("M04 M05 M15 M16 M17 M18 M19 M28 U02")
def inclusion_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four classifiers on the rows without a bin, reduced to confidence tiers."""
    binned, free = binned_and_free(spark, sf_dir)
    scaler = features.Standardiser.fit(binned)
    components = features.Components.fit(scaler.apply(binned))
    train = cut_lineage(components.apply(scaler.apply(binned)))
    asked = cut_lineage(components.apply(scaler.apply(free)))
    votes = shape.union_strict(
        classify.predict(classify.random_forest(train, asked), "rf"),
        classify.predict(neighbours.knn_classify(train, asked, 3), "knn"),
        classify.predict(classify.rbf_machine(train, asked), "svm"),
        classify.predict(classify.LinearDiscriminant.fit(train).probabilities(asked), "lda"),
    )
    return scoring.confidence_tiers(cut_lineage(votes))


