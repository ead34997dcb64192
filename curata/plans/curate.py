"""The curation job: structure files to records, shards, exports and the clustered index."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.text import chain_key
from curata.operators import catalog, clustering, curate, growing, layout, pairs
from curata.plans import registry
from curata.schema import INDEX, cluster_column
from curata.session import stage, stage_once, staging_path, table_exists
from curata.sinks import writers
from curata.sources import mmcif

# Bytes of a residue in a record (14 atoms with position, mask,
# B factor and occupancy; one confidence and one letter).
RESIDUE_BYTES = 14 * (3 * 4 + 1 + 4 + 4) + 4 + 1
SHARD_PREFIX = "experimental"


@dataclass(frozen=True)
class CurateConfig:
    methods: tuple[str, ...] = curate.METHODS
    max_resolution: float = 3.5
    min_chain_length: int = 4
    shard_bytes: int = layout.TARGET
    lanes: int = 8  # open shards at a time; part of the layout
    zstd_level: int = writers.ZSTD_LEVEL
    kmer: int = 3
    pair_similarity: float = 0.3  # least k-mer overlap of a listed sequence score
    shape_similarity: float = 0.3  # least overlap of local shapes of a listed structure score
    skip_structure_at: float = 0.95
    structure_radius: float = 15.0
    export_cif: bool = False  # one small file per chain, for outside tools

    def __post_init__(self):
        curate.check_min_chain(self.min_chain_length)


@dataclass(frozen=True)
class ClusterConfig:
    """Sequence (``mmseqs``) and structure (``foldseek``) clustering."""

    seq_thresholds: tuple[float, ...] = (0.3,)
    structure_thresholds: tuple[float, ...] = (0.7,)
    coverage: float = 0.8
    cov_mode: int = 0
    identity_mode: int = 0
    min_aln_len: int = 0
    cluster_mode: str = clustering.SET_COVER
    kmer: int = 3
    reassign: bool = True  # members move to the representative they match best
    shape_similarity: float = 0.3
    radius: float = 15.0
    columns: list[str] = field(init=False)

    def __post_init__(self):
        registry.lookup("cluster", self.cluster_mode)
        names = [cluster_column("mmseqs", t) for t in self.seq_thresholds]
        names += [cluster_column("foldseek", t) for t in self.structure_thresholds]
        object.__setattr__(self, "columns", names)


def judge(files: DataFrame, cfg: CurateConfig) -> DataFrame:
    """Entries of all files with ``reject_reason``, the first check that fails, or null.

    ``files`` has ``path, content, is_refined``.  Refined files carry no
    method; all of them are X-ray.  A value that cannot be read fails its
    check; no file ends the job.
    """
    entries = mmcif.entries(files.withColumn("content", F.coalesce("content", F.lit(""))))
    override = F.when(F.col("is_refined"), F.lit(cfg.methods[0]))
    marked = entries.withColumn("method", curate.matched_method("raw_method", cfg.methods, override))
    resolution = F.col("resolution")
    checks = {
        "no entry id": F.col("pdb") != "",
        "no atoms": F.contains("content", F.lit("_atom_site.")),
        "method": F.col("method").isNotNull(),
        "no resolution": resolution != 0,
        "resolution": resolution <= cfg.max_resolution,
    }
    return marked.withColumn("source", catalog.source_label()).withColumn("reject_reason", catalog.first_failed(checks))


def accept(files: DataFrame, cfg: CurateConfig) -> DataFrame:
    """Entries that pass all checks of ``judge``."""
    return judge(files, cfg).filter("reject_reason IS NULL").drop("reject_reason")


def build_chains(accepted: DataFrame, cfg: CurateConfig) -> DataFrame:
    """Chain records of the accepted entries."""
    return curate.resolve_chains(mmcif.atom_rows(accepted), cfg.min_chain_length)


def ca_trace(chains: DataFrame) -> DataFrame:
    """Add ``trace``, the flat CA coordinates of residues that have a CA."""
    zipped = F.arrays_zip("coords", "atom_mask")
    with_ca = F.filter(zipped, lambda r: r["atom_mask"][1])
    flat = F.flatten(F.transform(with_ca, lambda r: F.transform(r["coords"][1], lambda x: x.cast("double"))))
    return chains.withColumn("trace", flat)


def chain_scores(chains: DataFrame, cfg: CurateConfig) -> tuple[DataFrame, DataFrame]:
    """Directed structure and sequence scores between distinct sequences of a record.

    Returns ``members`` (pdb, chain, chain_no, rep) and ``pairs`` (pdb, a, b,
    score, identity, score_ab, score_ba).  Copies of a sequence share one
    entity.  A pair is compared when its k-mers or its local shapes overlap
    enough; ``score``, the overlap of the k-mers, and ``identity``, the edit
    similarity, are null where only the shapes do.  Coordinates
    are compared at the offset that most local shapes vote for.
    """
    copies = pairs.collapse_copies(chains.select("pdb", "chain", "sequence"), ["pdb"], "chain", "sequence")
    members = copies.select("pdb", "chain", F.col("chain").alias("chain_no"), "rep")
    entities = ca_trace(chains).join(members.filter("chain = rep").select("pdb", "chain"), ["pdb", "chain"], "left_semi")
    tokens = pairs.token_hashes(pairs.kmers("sequence", cfg.kmer))
    found = pairs.similar_pairs(
        entities.select("pdb", "chain", tokens.alias("tokens")), ["pdb"], "chain", "tokens", cfg.pair_similarity
    )
    worded = entities.select("pdb", "chain", pairs.shape_words("trace").alias("words"))
    shapes = pairs.shape_sets(worded, ["pdb"], "chain", "words")
    shaped = pairs.similar_pairs(shapes, ["pdb"], "chain", "tokens", cfg.shape_similarity).select("pdb", "a", "b")
    either = pairs.with_offsets(found.join(shaped, ["pdb", "a", "b"], "full"), worded, ["pdb"], "chain", "words")
    scored = pairs.structure_scores(either, entities, ["pdb"], "chain", "trace", cfg.skip_structure_at, cfg.structure_radius)
    side = lambda name: entities.select("pdb", F.col("chain").alias(name), F.col("sequence").alias(f"_{name}"))
    named = scored.drop("offset").join(side("a"), ["pdb", "a"]).join(side("b"), ["pdb", "b"])
    identity = F.when(F.col("score").isNotNull(), pairs.edit_similarity("_a", "_b"))
    return members, named.withColumn("identity", identity).drop("_a", "_b")


def build_records(accepted: DataFrame, chains: DataFrame, cfg: CurateConfig) -> DataFrame:
    """One nested row per record: chains by name, assemblies, metadata, score matrices."""
    fields = ["sequence", "coords", "atom_mask", "bfactor", "plddt", "occupancy"]
    nested = chains.groupBy("pdb").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("chain", "sequence")))).alias("_names"),
        F.map_from_entries(F.collect_list(F.struct("chain", F.struct(*fields)))).alias("chains"),
        F.sum(F.length("sequence") * RESIDUE_BYTES).alias("size"),
    )
    known = chains.select("pdb", "chain")
    generators, operators = mmcif.generator_rows(accepted), mmcif.operator_rows(accepted)
    assemblies = curate.nest_assemblies(
        curate.generator_members(generators, known), curate.assembly_transforms(generators, operators)
    )
    members, scored = chain_scores(chains, cfg)
    scored = stage(scored, "chain-scores")
    structure = pairs.both_directions(
        scored.select("pdb", "a", "b", "score_ab", "score_ba"), ["pdb"], score="score_ab", back="score_ba"
    ).withColumnRenamed("score_ab", "score")
    sequence = pairs.both_directions(scored.filter("identity IS NOT NULL"), ["pdb"], score="identity")
    sequence = sequence.withColumnRenamed("identity", "score")
    nan = F.lit(float("nan"))
    meta = accepted.select(
        "pdb", "resolution", "method", "deposit_date", "source", nan.alias("mean_plddt"), nan.alias("ptm")
    )
    return (
        nested.withColumn("chain_ids", F.map_keys("_names"))
        .drop("_names")
        .join(meta, "pdb")
        .join(assemblies, "pdb", "left")
        .withColumn("assemblies", F.coalesce("assemblies", F.array().cast(assemblies.schema["assemblies"].dataType)))
        .join(pairs.record_matrix(structure, members, ["pdb"]).withColumnRenamed("matrix", "chain_tm_scores"), "pdb")
        .join(pairs.record_matrix(sequence, members, ["pdb"]).withColumnRenamed("matrix", "chain_seq_identity"), "pdb")
    )


def place_records(records: DataFrame, cfg: CurateConfig, first_shard: int = 0) -> DataFrame:
    """Shard number, shard id and byte range of each record."""
    sizes = records.select("pdb", "size", F.lit(SHARD_PREFIX).alias("prefix"))
    return layout.exact_shards(
        sizes, "pdb", source="prefix", target=cfg.shard_bytes, lanes=cfg.lanes, first_shard=first_shard
    )


def index_of(records: DataFrame, placed: DataFrame) -> DataFrame:
    """One index row per chain."""
    meta = ["pdb", "source", "chain_ids", "resolution", "method", "deposit_date", "mean_plddt", "ptm"]
    rows = records.select(*meta).join(placed.select("pdb", "shard_id", "offset", "size"), "pdb")
    return layout.index_rows(rows).select(*INDEX.names)


def cluster_input(chains: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """``member, content, len, tokens, words, trace`` of each chain."""
    return ca_trace(chains).select(
        chain_key().alias("member"),
        clustering.content_key("sequence").alias("content"),
        F.length("sequence").alias("len"),
        pairs.kmer_stream("sequence", cfg.kmer).alias("tokens"),
        pairs.shape_words("trace").alias("words"),
        "trace",
    )


def grow_clusters(spark: SparkSession, base: str, n: int, chains: DataFrame, cfg: ClusterConfig) -> None:
    """File the chains of batch ``n`` under ``base`` and find their edges to all chains so far.

    Chains of equal sequence are one entity, the first that came, so copies
    always stay together and cost nothing.  New entities meet old ones and
    each other through stored tokens (``growing.TokenIndex``); no chain of an
    earlier batch is parsed or compared again.  Every pair that reaches the
    lowest threshold is found and scored once.  Structure pairs do not depend
    on the sequence: entities meet that share ``shape_similarity`` of their
    local shapes, wherever these stand, and each copy meets its entity; all of
    them are scored by their coordinates, at the offset that most shapes vote
    for.
    """
    def step(name, build):
        return stage_once(spark, f"{base}/{name}/batch={n}", build)

    given = step("input", lambda: cluster_input(chains, cfg))

    def firsts():
        own = given.groupBy("content").agg(F.min("member").alias("entity"))
        return own.join(_batches(spark, base, "entities", n).select("content"), "content", "left_anti") if n else own

    entities = step("entities", firsts)
    every, known = _batches(spark, base, "input", n + 1), _batches(spark, base, "entities", n + 1)
    fresh = given.join(entities.select("content", F.col("entity").alias("member")), ["content", "member"], "left_semi")
    firsts_only = every.join(known.select("content", F.col("entity").alias("member")), ["content", "member"], "left_semi")
    if cfg.seq_thresholds:
        sets = fresh.select("content", F.array_distinct("tokens").alias("set"))
        index = growing.TokenIndex(f"{base}/seq-index", min(cfg.seq_thresholds), cfg.identity_mode)
        found = index.add(sets, "content", "set", n)
        step(
            "seq-edges",
            lambda: clustering.covering(
                found, firsts_only.select("content", "tokens"), "content", "tokens", cfg.kmer, cfg.coverage, cfg.cov_mode, cfg.min_aln_len
            ),
        )
    if cfg.structure_thresholds:
        index = growing.TokenIndex(f"{base}/shape-index", cfg.shape_similarity)
        alike = index.add(pairs.shape_sets(fresh, [], "content", "words"), "content", "tokens", n)
        side = lambda name: known.select(F.col("content").alias(name), F.col("entity").alias(f"_{name}"))
        met = alike.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        copies = given.join(known, "content").filter("member <> entity")
        either = met.unionByName(copies.select(F.col("member").alias("a"), F.col("entity").alias("b")))

        def scored():
            placed = pairs.with_offsets(either, every.select("member", "words"), [], "member", "words")
            unscored = placed.withColumn("score", F.lit(None).cast("double"))
            found = pairs.structure_scores(unscored, every, [], "member", "trace", radius=cfg.radius)
            return found.select("a", "b", F.least("score_ab", "score_ba").alias("score"))

        step("structure-edges", scored)
    stage_once(spark, f"{base}/done/batch={n}", lambda: spark.range(1))


def grown_clusters(spark: SparkSession, base: str, n: int, cfg: ClusterConfig) -> DataFrame:
    """``member`` and one representative column per clustering and threshold, from the edges of ``n`` batches.

    Sequence clusters are made of contents and named by the smallest member
    of the content that stands for them, so they do not depend on how the
    chains were split into batches.
    """
    every = _batches(spark, base, "input", n).select("member", "content", "len")
    contents = every.groupBy("content").agg(F.min("member").alias("name"), F.max("len").alias("len"))
    contents = stage(contents, "cluster-contents")
    out = every.select("member", "content")
    if cfg.seq_thresholds:
        lengths = contents.select(F.col("content").alias("v"), "len")
        swept = clustering.threshold_sweep(
            _batches(spark, base, "seq-edges", n), contents.select(F.col("content").alias("member")), cfg.seq_thresholds,
            "mmseqs", cfg.cluster_mode, lengths, cfg.reassign,
        )
        for t in cfg.seq_thresholds:
            column = cluster_column("mmseqs", t)
            named = contents.select(F.col("content").alias(column), F.col("name").alias("_name"))
            swept = swept.join(named, column).drop(column).withColumnRenamed("_name", column)
        out = out.join(swept.withColumnRenamed("member", "content"), "content")
    out = out.drop("content")
    if cfg.structure_thresholds:
        lengths = every.select(F.col("member").alias("v"), "len")
        by_structure = clustering.threshold_sweep(
            _batches(spark, base, "structure-edges", n), every.select("member"), cfg.structure_thresholds, "foldseek",
            cfg.cluster_mode, lengths, cfg.reassign,
        )
        out = out.join(by_structure, "member")
    return out


def cluster_chains(chains: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """The clusters of chains that come at once; see ``grow_clusters`` and ``grown_clusters``."""
    spark = chains.sparkSession
    base = staging_path(spark, "clusters")
    grow_clusters(spark, base, 0, chains, cfg)
    return grown_clusters(spark, base, 1, cfg)


def folder(out: str, cfg: CurateConfig = CurateConfig()) -> str:
    """Where the tables of this configuration are: another one never reads them."""
    return f"{out}/{_key(cfg)}"


def _key(settings) -> str:
    return hashlib.md5(repr(settings).encode()).hexdigest()[:12]


def _batches(spark: SparkSession, base: str, name: str, n: int) -> DataFrame:
    """The rows of a table in its first ``n`` batches."""
    return spark.read.parquet(*[f"{base}/{name}/batch={k}" for k in range(n)])


def rejects(spark: SparkSession, out: str, cfg: CurateConfig = CurateConfig()) -> DataFrame:
    """``path, pdb, reject_reason`` of every file that the job left out under these settings."""
    base = folder(out, cfg)
    n = 0
    while table_exists(spark, f"{base}/rejects/batch={n}"):
        n += 1
    return _batches(spark, base, "rejects", n)


def _run_batch(spark: SparkSession, files: DataFrame, base: str, n: int, cfg: CurateConfig) -> None:
    """Batch ``n``: entries that no earlier batch has, in shards after those of earlier batches."""
    def step(name, build):
        return stage_once(spark, f"{base}/{name}/batch={n}", build)

    def once(name, write):
        if not table_exists(spark, f"{base}/{name}/batch={n}"):
            write(f"{base}/{name}/batch={n}")

    def gated():
        found = judged.filter("reject_reason IS NULL").drop("reject_reason")
        return catalog.remaining(found, _batches(spark, base, "accepted", n)) if n else found

    def rejected():
        failed = judged.filter("reject_reason IS NOT NULL").select("path", "pdb", "reject_reason")
        empty = catalog.remaining(accepted, chains).select("path", "pdb", F.lit("no chains").alias("reject_reason"))
        return failed.unionByName(empty)

    def laid_out():
        first = _batches(spark, base, "placed", n).agg(F.max("shard_no")).first()[0] if n else None
        return place_records(records, cfg, 0 if first is None else first + 1)

    judged = step("judged", lambda: judge(files, cfg))
    accepted = step("accepted", gated)
    chains = step("chains", lambda: build_chains(accepted, cfg))
    step("rejects", rejected)
    records = step("records", lambda: build_records(accepted, chains, cfg))
    placed = step("placed", laid_out)
    whole = records.join(placed.select("pdb", "shard_no", "offset", F.col("prefix")), "pdb")
    once("shards", lambda path: writers.write_shards(whole, path, "prefix", order=["offset"], level=cfg.zstd_level))
    once("checkpoint", lambda path: index_of(records, placed).write.mode("overwrite").json(path))
    once("fasta", lambda path: writers.write_fasta(chains, path))
    if cfg.export_cif:
        once("cif", lambda path: writers.write_backbone_cif(writers.chain_cif(chains), path))


def run_from(
    spark: SparkSession, locations: dict[str, str], out: str, cfg: CurateConfig = CurateConfig(), clusters: ClusterConfig = ClusterConfig()
) -> DataFrame:
    """``run`` on the files of named sources: source name to location."""
    readers = {name: registry.lookup("source", name) for name in locations}
    columns = ["path", "content", "is_refined"]
    parts = [readers[name](spark, location).select(columns) for name, location in locations.items()]
    return run(spark, reduce(DataFrame.unionByName, parts), out, cfg, clusters)


def run(spark: SparkSession, files: DataFrame, out: str, cfg: CurateConfig = CurateConfig(), clusters: ClusterConfig = ClusterConfig()) -> DataFrame:
    """Curate ``files`` into ``folder(out, cfg)`` and return the index of all files so far.

    Files whose path is new make a batch: their paths are written first, then
    its steps (shards, then the checkpoint of their rows), each a finished
    table that is not built again, then ``done``.  A job that was stopped goes
    on inside its batch; a run with more files adds a batch with the next shard
    numbers.  An entry that an earlier batch has is left out.  A file that fails
    a check goes to the rejects of its batch with the reason; other settings
    have a folder of their own and try it again.  Clusters grow with each
    batch and are kept by their settings.
    """
    base, n = folder(out, cfg), 0
    while table_exists(spark, f"{base}/done/batch={n}"):
        n += 1
    while True:
        ledger = f"{base}/files/batch={n}"
        if not table_exists(spark, ledger):
            new = files.select("path").distinct()
            if n:
                new = catalog.remaining(new, _batches(spark, base, "files", n), "path")
            new = stage(new, "new-files")
            if n and new.isEmpty():
                break
            new.write.mode("overwrite").parquet(ledger)
        paths = spark.read.parquet(ledger)
        _run_batch(spark, files.join(paths, "path", "left_semi"), base, n, cfg)
        stage_once(spark, f"{base}/done/batch={n}", lambda paths=paths: paths)
        n += 1

    grown = f"{base}/clusters-{_key(clusters)}"
    for k in range(n):
        if not table_exists(spark, f"{grown}/done/batch={k}"):
            grow_clusters(spark, grown, k, spark.read.parquet(f"{base}/chains/batch={k}"), clusters)

    def clustered():
        rows = index_of(_batches(spark, base, "records", n), _batches(spark, base, "placed", n))
        return catalog.cluster_columns(rows, grown_clusters(spark, grown, n, clusters), clusters.columns)

    return stage_once(spark, f"{base}/index-{_key(clusters)}/batches-{n}", clustered)
