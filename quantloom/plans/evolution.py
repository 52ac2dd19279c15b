"""The genetic search: evaluate a population on bars, keep the best, breed the next generation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed, selection, simulator, variation
from ..operators.base import Mutation
from ..operators.trees import require_valid, uniform
from ..sources.storage import cut_lineage, written

#: Names of the mutations and our default rates; a configuration gives its own.
RATES = {"add_node": 0.2, "delete_node": 0.2, "add_subtree": 0.2, "delete_subtree": 0.2, "reinitialize_node": 0.05, "node_param": 0.1}


@dataclass(frozen=True)
class Search:
    """parents: size of the mating pool; rates: of each mutation, in the order of the chain; weights: of subtree, node and
    root-branch crossover; noise, leverage_step: how far parameters move; most_added, most_deleted: nodes that one mutation adds or
    deletes at most; subtree_nodes: decisions of an added subtree; pool_size, warming: the pool of the best trees, and the generations before it is filled;
    the rest as named."""

    catalog: list[tuple]
    population: int = 64
    n_elites: int = 4
    parents: int = 16
    pool_size: int = 8
    warming: int = 0
    min_compound: float = 6.0
    most_drawdown: float = 0.6
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3)
    rates: dict[str, float] = field(default_factory=lambda: dict(RATES))
    tournament: int = 0  # entries of a tournament; 0 selects by roulette
    crossover_rate: float = 0.8
    minimum_trades: int = 1
    fitness_weights: dict[str, float] = field(default_factory=lambda: dict(simulator.WEIGHTS))
    noise: float = 0.1
    leverage_step: float = 5.0
    most_added: int = 1
    most_deleted: int = 1
    subtree_nodes: tuple[int, int] = (1, 3)
    max_depth: int = 6
    max_children: int = 30
    max_nodes: int = 256
    seed: int = 0
    market: simulator.Market = field(default_factory=simulator.Market)

    def __post_init__(self) -> None:
        if not 0 <= self.n_elites < self.population:
            raise ValueError("there must be fewer elites than trees")
        if self.parents > self.population or self.parents < 1:
            raise ValueError("the mating pool can't be larger than the population")
        if unknown := set(self.rates) - set(RATES):
            raise ValueError(f"no mutations are named {sorted(unknown)}")


def evaluate(nodes: DataFrame, features: DataFrame, bars: DataFrame, search: Search) -> DataFrame:
    """(tree_id, metrics..., fitness) of a population.

    features: (series..., bar, features).  Every series is traded for itself; a tree's metrics are those of all its
    series' profits, by bar."""
    series = tuple(c for c in features.columns if c not in ("bar", "features"))
    acts = packed.predict_packed(nodes, features, search.max_depth)
    profits = simulator.simulate(acts, bars, search.market, series)
    measured = simulator.metrics(profits.select("tree_id", F.struct("bar", *series).alias("bar"), "profit"), search.minimum_trades)
    trees = nodes.select("tree_id").distinct()
    return trees.join(measured, "tree_id", "left").join(simulator.fitness(measured, search.fitness_weights), "tree_id", "left").fillna(-1.0, ["fitness"])


def parent_pairs(fitness: DataFrame, search: Search, seed: int) -> DataFrame:
    """(child, first, second): two parents for each child to come, drawn from the mating pool of the fittest."""
    n = search.population - search.n_elites
    pool = selection.elites(fitness.select("tree_id", "fitness"), search.parents)
    drawn = selection.draws(fitness.sparkSession, 2 * n, seed)
    if search.tournament:
        entries = drawn.withColumn("entry", F.explode(F.sequence(F.lit(0), F.lit(search.tournament - 1)))).withColumn("u", uniform(seed, "draw", "entry"))
        parents = selection.tournament(pool, entries)
    else:
        parents = selection.roulette(pool, drawn)
    child = F.floor(F.col("draw") / 2).alias("child")
    return parents.groupBy(child).agg(F.min_by("tree_id", "draw").alias("first"), F.max_by("tree_id", "draw").alias("second"))


def offspring(nodes: DataFrame, fitness: DataFrame, search: Search, generation: int) -> DataFrame:
    """Children of parents drawn from the mating pool, crossed and mutated."""
    seed = search.seed * 1_000_003 + generation
    pairs = parent_pairs(fitness, search, seed)
    pairs = cut_lineage(pairs)  # every step reads its input many times
    born = variation.crossover_chain(pairs, nodes, seed, search.weights, search.crossover_rate, search.max_depth, search.max_nodes)
    for mutate in mutations(search, seed):
        born = mutate(written(born))
    return born


def mutations(search: Search, seed: int) -> list[Mutation]:
    """The chain of mutations that have a rate above 0: nodes to nodes, each valid."""
    c, depth, children, size = search.catalog, search.max_depth, search.max_children, search.max_nodes
    chain: dict[str, Callable[[DataFrame, float], DataFrame]] = {
        "add_node": lambda n, r: variation.repeated(n, lambda m, s, hit: variation.add_node(m, c, s, hit, depth, size), seed, "add_node", r, search.most_added),
        "delete_node": lambda n, r: variation.repeated(n, lambda m, s, hit: variation.delete_node(m, s, hit, depth, children), seed, "delete_node", r, search.most_deleted),
        "add_subtree": lambda n, r: variation.add_subtree(n, c, seed, r, search.subtree_nodes[1], depth, children, size, search.subtree_nodes[0]),
        "delete_subtree": lambda n, r: variation.delete_subtree(n, seed, r),
        "reinitialize_node": lambda n, r: variation.reinitialize_nodes(n, c, seed, r, depth),
        "node_param": lambda n, r: variation.mutate_parameters(n, c, seed, r, search.noise, search.leverage_step),
    }
    return [lambda n, f=f, r=search.rates[name]: f(n, r) for name, f in chain.items() if search.rates.get(name, 0) > 0]


def _pooled(spark: SparkSession, path: str, g: int, nodes: DataFrame, scored: DataFrame, search: Search) -> None:
    """Writes the pool after a generation: the best trees so far, with their fitness, under numbers of their own."""
    new = scored.select((F.lit(g * search.population) + F.col("tree_id")).alias("tree_id"), "fitness", "compound_value", "max_drawdown")
    kept = [n for n in range(g) if _exists(spark, f"{path}/generation={n}/pool/_SUCCESS")][-1:]
    before = [spark.read.parquet(f"{path}/generation={n}/pool") for n in kept]
    scores = before[0].select("tree_id", "fitness").distinct() if before else new.select("tree_id", "fitness").limit(0)
    best = cut_lineage(selection.best_pool(scores, new, search.pool_size, search.min_compound, search.most_drawdown))
    own = nodes.withColumn("tree_id", F.lit(g * search.population) + F.col("tree_id"))
    trees = own.unionByName(before[0].drop("fitness")) if before else own
    trees.join(F.broadcast(best), "tree_id").write.mode("overwrite").parquet(f"{path}/generation={g}/pool")  # pool_size rows are broadcast


def best_trees(spark: SparkSession, path: str) -> DataFrame:
    """The nodes and fitness of the best trees of all generations under path."""
    return spark.read.parquet(f"{path}/generation={_latest(spark, path)}/pool")


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def evolve(spark: SparkSession, nodes: DataFrame, features: DataFrame, bars: DataFrame, search: Search, generations: int, path: str, report: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """Runs generations and returns the last population; each one is written under path, where a later call goes on.

    path/generation=N holds the Parquet tables nodes (of the next generation), fitness and pool, in a folder all executors share."""
    done = _latest(spark, path)
    start = 0 if done is None else done + 1
    if done is not None:
        nodes = spark.read.parquet(f"{path}/generation={done}/nodes")
    for g in range(start, generations):
        scored = evaluate(nodes, features, bars, search)
        scored.write.mode("overwrite").parquet(f"{path}/generation={g}/fitness")
        scored = spark.read.parquet(f"{path}/generation={g}/fitness")
        if report:
            report(g, scored)
        if g >= search.warming:
            _pooled(spark, path, g, nodes, scored, search)
        elite = selection.elites(scored.select("tree_id", "fitness"), search.n_elites)
        new = selection.next_generation(nodes, elite, offspring(nodes, scored, search, g))
        new.write.mode("overwrite").parquet(f"{path}/generation={g}/nodes")
        nodes = spark.read.parquet(f"{path}/generation={g}/nodes")
        require_valid(nodes, max_depth=search.max_depth, max_children=search.max_children)
    return nodes


def _latest(spark: SparkSession, path: str) -> int | None:
    """The last generation whose nodes were written whole."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/generation=*/nodes/_SUCCESS")
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files)
    numbers = [int(str(f.getPath()).split("generation=")[1].split("/")[0]) for f in found or ()]
    return max(numbers, default=None)


def split(bars: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """The first part of each symbol's numbered bars, by ratio, and the rest."""
    last = bars.groupBy("symbol").agg((F.max("bar") * ratio).cast("long").alias("_last"))
    met = bars.join(last, "symbol")
    return tuple(met.where(when).select(bars.columns) for when in ("bar < _last", "bar >= _last"))
