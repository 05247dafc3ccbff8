"""End-to-end runs: panel and read counts to estimates, decoded bins, tracts and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import fstats as FS
from strandline.operators import hmm as H
from strandline.operators import sfs as M
from strandline.operators import sites as S
from strandline.operators import tracts as T
from strandline.plans.tables import materialise
from strandline.sources.sinks import interval, params_yaml, write_table, write_vcf
from strandline.sources.text import load_counts
from strandline.states import StateSpace


@dataclass(frozen=True)
class HmmConfig:
    """Options of an ancestry run; lengths of bins in the unit of ``by`` (cM for 'map', bp for 'pos')."""

    sources: tuple[str, ...] = ("AFR", "NEA", "DEN")
    homo: tuple[str, ...] | None = None
    het: tuple[tuple[str, str], ...] | None = None
    inbreeding: bool = False
    cont: str = "AFR"
    ancestral: str | None = None
    by: str = "map"
    bin_size: float = 0.01
    snp_mode: bool = False  #: a bin per site
    gt_mode: bool = False  #: counts are alleles of called genotypes
    sex: str | None = None  #: 'm' or 'f' makes X or Z haploid; None leaves every chromosome but those of haplo_chroms diploid
    haplo_chroms: tuple[str, ...] = ()
    prior: float | None = None  #: pseudo-count; None estimates it from the panel
    ancestral_prior: float = 0.0
    delta: float | None = None
    thin: float | None = None
    high_cov: float | None = 0.001
    downsample: float = 1.0
    fake_contamination: float = 0.0
    autosomes: bool = False
    split_lib: bool = True
    max_iter: int = 1000
    ll_tol: float = 0.01
    est_cont: bool = True
    est_error: bool = False
    est_f: bool = False
    est_tau: bool = False
    est_trans: bool = True
    freq_cont: int = 1
    freq_f: int = 1
    cont0: float = 0.01
    error0: float = 0.01
    f0: float = 0.01
    tau0: float = 0.8
    favoured: tuple[str, ...] = ()  #: states that start with more weight
    rates: tuple[tuple[float, ...], ...] | None = None  #: between sources, per unit of ``by``, as start of the transitions
    run_penalty: float = 0.2
    replicates: int = 100
    seed: int = 0
    outputs: tuple[str, ...] = ("bin", "snp", "cont", "rle", "sim", "occupancy", "pars")


PRESETS: Mapping[str, HmmConfig] = {
    "basic": HmmConfig(max_iter=250, replicates=200),
    "fixed": HmmConfig(est_cont=False, est_trans=False),
    "downsample": HmmConfig(downsample=0.1),
    "fake-contamination": HmmConfig(fake_contamination=0.1),
    "delta": HmmConfig(delta=0.2),
    "genotypes": HmmConfig(gt_mode=True, est_cont=False, split_lib=False, high_cov=None),
}


@dataclass
class HmmResult:
    fit: H.HmmFit
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, path: str, fmt: str = "csv") -> None:
        """A table each, and the parameters as YAML text."""
        for name, df in self.tables.items():
            write_table(df, f"{path}.{name}", fmt)
        if "pars" in self.tables:
            text = params_yaml({**asdict(self.fit.params), "ll": self.fit.ll, "converged": self.fit.converged})
            self.tables["pars"].sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.yaml")


def haploid_chromosomes(sites: DataFrame, sex: str | None, listed: Sequence[str] = ()) -> tuple[str, ...]:
    """The listed chromosomes, or those that are haploid in this sex; names of chromosomes are few."""
    names = sorted(r[0] for r in sites.select("chrom").distinct().where((S.ploidy(F.col("chrom"), sex) == 1) if sex else F.lit(True)).collect())
    return tuple(c for c in names if c in listed) if listed else tuple(names) if sex else ()


def cont_by_group(est: DataFrame, reads: DataFrame, n_snps: int) -> DataFrame:
    """Estimates per read group with its parts (library, length bin, damage class) and its number of reads."""
    x = F.split("lib", "_")
    three = F.size(x) == 3
    e = est.select(F.col("lib").alias("rg"), "cont", "error", F.when(three, x[0]).otherwise(F.col("lib")).alias("lib"), F.when(three, x[1]).otherwise("0").alias("len_bin"), F.when(three, x[2]).otherwise("NA").alias("deam"))
    n = reads.groupBy(F.col("lib").alias("rg")).agg(F.sum(F.col("tref") + F.col("talt")).alias("n_reads"))
    return e.join(n, "rg", "left").withColumn("n_snps", F.lit(n_snps))


def hmm_inputs(panel: DataFrame, counts: DataFrame, c: HmmConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(read counts, sites, bins) of a run: filtered, with bins, pseudo-counts and the contaminant's frequency."""
    from strandline.operators.panelstats import downsample_counts, fake_contamination

    sites = S.first_per_key(panel.where("chrom is not null and pos is not null"), ["chrom", "pos"], ["ref", "alt"])
    if c.by == "pos":
        sites = sites.withColumn("map", F.col("pos").cast("double"))
    sites = S.autosomes_only(sites) if c.autosomes else sites
    sites = S.with_data(sites, c.ancestral) if c.ancestral else sites
    sites = S.delta_filter(sites, c.sources, c.delta) if c.delta is not None else sites
    sites = S.greedy_thin(sites, c.by, c.thin) if c.thin is not None else sites
    obs = load_counts(counts, c.split_lib)
    obs = downsample_counts(obs, ["chrom", "pos", "lib"], c.downsample, c.seed) if c.downsample < 1 else obs
    obs = S.coverage_filter(obs, c.high_cov) if c.high_cov is not None else obs
    pops = list(dict.fromkeys([*c.sources, c.cont]))
    if c.snp_mode:
        snps = S.site_bins(sites)
        bins = snps.select("chrom", "bin", F.col("map").cast("double").alias("start"))
    else:
        snps, bins = S.snp_bins(sites, "map", c.bin_size), S.genome_bins(sites, "map", c.bin_size).select("chrom", "bin", "start")
    snps = S.with_priors(snps, pops, c.prior, c.ancestral, c.ancestral_prior)
    freq = (F.col(f"{c.cont}_alt") + F.col(f"{c.cont}_pa")) / F.nullif(F.col(f"{c.cont}_alt") + F.col(f"{c.cont}_ref") + F.col(f"{c.cont}_pa") + F.col(f"{c.cont}_pb"), F.lit(0.0))
    snps = snps.withColumn("p_cont", F.coalesce(F.round(freq, 6), F.lit(0.5)))
    o = obs.join(snps.select("chrom", "pos", "bin", "p_cont"), ["chrom", "pos"])
    if c.fake_contamination:
        o = fake_contamination(o, ["chrom", "pos", "lib"], "p_cont", c.fake_contamination, c.seed)
    return o, snps, bins


def hmm_site_table(o: DataFrame, snps: DataFrame, decoded: DataFrame, fit: H.HmmFit, space: StateSpace, hap: Sequence[str], calls: bool) -> DataFrame:
    """One row per site with reads: reads, log10 posterior genotypes, alternative share and a random draw by a hash of the site."""
    from strandline.operators.extras import log10_table
    from strandline.operators.panelstats import md5_uniform

    site = ["chrom", "bin", "pos"]
    lik = H.snp_log_likelihood(o, site, "p_cont", H._per_lib(fit.params.cont, F.col("lib")), H._per_lib(fit.params.error, F.col("lib")), calls)
    reads = o.groupBy(*site).agg(F.sum("tref").alias("tref"), F.sum("talt").alias("talt"))
    pg = H.posterior_genotypes(snps.join(lik, site), decoded, ["chrom", "bin"], H.state_genotypes(space, fit.params.f, fit.params.tau, None, H.is_haploid(hap)), space.names)
    total = lambda k: F.aggregate("pg", F.lit(0.0), lambda acc, s: acc + F.element_at(s, k + 1))
    g = [total(k) for k in range(3)]
    x = pg.select(*site, "map", "ref", "alt", *[v.alias(f"g{k}") for k, v in enumerate(g)]).join(reads, site)
    p = F.col("g1") / 2 + F.col("g2")
    return x.select(*site, "map", "ref", "alt", "tref", "talt", *[v.alias(f"log_g{k}") for k, v in enumerate(log10_table([F.col(f"g{k}") for k in range(3)]))], p.alias("p"), F.when(md5_uniform(F.lit("site"), F.col("chrom"), F.col("pos")) < p, 1).otherwise(0).alias("random_read"))


def run_hmm(panel: DataFrame, counts: DataFrame, config: HmmConfig = HmmConfig()) -> HmmResult:
    """``panel``: chrom, pos, ref, alt, map and {source}_ref/_alt; ``counts``: chrom, pos, lib, tref, talt of one sample."""
    c = config
    o, snps, bins = hmm_inputs(panel, counts, c)
    hap = haploid_chromosomes(snps, c.sex, c.haplo_chroms)
    space = StateSpace(c.sources, c.homo, c.het, c.inbreeding)
    libs = [r[0] for r in o.select("lib").distinct().collect()]  # read groups are few
    start = H.HmmParams.initial(space, libs, cont=c.cont0, error=c.error0, f=c.f0, tau=c.tau0)
    start = start.favouring(space, c.favoured) if c.rates is None else start.with_rates(space, c.rates, c.bin_size)
    fit = H.fit_hmm(
        o, snps, bins.select("chrom", "bin"), space, start, max_iter=c.max_iter, tol=c.ll_tol, est_cont=c.est_cont, est_error=c.est_error, est_f=c.est_f, est_tau=c.est_tau, est_trans=c.est_trans,
        prior=None, haploid=hap, calls=c.gt_mode, freq_cont=c.freq_cont, freq_f=c.freq_f,
    )
    with_reads = snps.join(o.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    n = with_reads.groupBy("bin").agg(F.count(F.lit(1)).alias("n_snps"))
    coords = S.bin_positions(bins, snps).select("chrom", "bin", F.col("start").alias("map"), "pos")
    decoded = H.decode(fit.bins, ["chrom"], "bin", fit.params, space.names, hap).drop("beta")
    out = {"bin": coords.join(decoded, ["chrom", "bin"]).join(n, "bin", "left").fillna(0, ["n_snps"]).withColumn("haploid", F.col("chrom").isin(*hap) if hap else F.lit(False))}
    out["snp"] = hmm_site_table(o, snps, decoded, fit, space, hap, c.gt_mode)
    targets = T.target_posteriors(decoded, space, ["chrom", "bin"])
    out["rle"] = T.run_coordinates(T.call_runs(targets, ["chrom", "target", "type"], "bin", c.run_penalty), coords, ["chrom"], "bin")
    out["sim"] = H.posterior_runs(fit.bins, ["chrom"], "bin", fit.params, space, c.replicates, c.seed, hap)
    out["occupancy"] = T.occupancy(out["sim"])
    spark = panel.sparkSession
    est = spark.createDataFrame([(k, fit.params.cont[k], fit.params.error[k]) for k in libs], "lib string, cont double, error double")
    if "cont" in c.outputs:
        out["cont"] = cont_by_group(est, o, with_reads.count())
    out["pars"] = spark.createDataFrame([(k, str(v)) for k, v in {**asdict(fit.params), "ll": fit.ll, "converged": fit.converged}.items()], "parameter string, value string")
    return HmmResult(fit, {k: v for k, v in out.items() if k in c.outputs})


@dataclass(frozen=True)
class SfsConfig:
    states: tuple[str, ...] = ("NEA",)
    cont: str = "AFR"
    ancestral: str = "PAN"
    sex: str = "f"
    jackknife: int = 0
    max_iter: int = 1000
    ll_tol: float = 0.01
    cont0: float = 0.01
    tau0: float = 0.8
    f0: float = 0.5
    e0: float = 0.01
    b0: float = 0.01
    gt_mode: bool = False  #: counts are alleles of called genotypes
    random_read: bool = False  #: of pseudo-haploid calls
    updates: M.SfsUpdates = M.SfsUpdates()
    outputs: tuple[str, ...] = ("pars", "sfs", "cont", "snp", "f2", "f3", "f4", "vcf")


def sfs_sites(panel: DataFrame, c: SfsConfig) -> DataFrame:
    """Sites with number, class, contaminant frequency (derived) and ploidy."""
    sites = S.with_data(S.first_per_key(panel, ["chrom", "pos"], ["ref", "alt"]), c.cont)
    s = M.categories(S.snp_ids(sites), list(c.states), c.ancestral, "snp_id")
    s = S.polarize(s, [c.cont], c.ancestral).withColumn("psi", F.col(f"{c.cont}_der") / F.nullif(F.col(f"{c.cont}_der") + F.col(f"{c.cont}_anc"), F.lit(0)))
    return s.withColumn("haploid", S.ploidy(F.col("chrom"), c.sex) == 1).withColumnRenamed("snp_id", "snp")


def sfs_data(panel: DataFrame, counts: DataFrame, c: SfsConfig) -> DataFrame:
    """(rep, snp, sfs, rg, psi, flipped, haploid, ref, alt): read counts, or with ``gt_mode`` one call (alt) per site."""
    s = sfs_sites(panel, c)
    o = load_counts(counts).select("chrom", "pos", F.col("lib").alias("rg"), F.col("tref").alias("n_ref"), F.col("talt").alias("n_alt"))
    if c.gt_mode:
        o = o.groupBy("chrom", "pos").agg(F.lit("calls").alias("rg"), F.sum("n_ref").alias("n_ref"), F.least(F.sum("n_alt"), F.lit(1 if c.random_read else 2)).alias("n_alt"))
    j = o.join(s.select("chrom", "pos", "snp", "sfs", "psi", "flipped", "haploid"), ["chrom", "pos"])
    return j.select(F.lit("0").alias("rep"), "snp", "sfs", "rg", "psi", "flipped", "haploid", F.col("n_ref").alias("ref"), F.col("n_alt").alias("alt"))


def run_sfs(panel: DataFrame, counts: DataFrame, config: SfsConfig = SfsConfig()) -> dict[str, DataFrame]:
    """Tables of the conditional SFS model: pars (with jackknife errors), sfs, cont, snp, f2, f3, f4, and the rows of a VCF."""
    c = config
    base = materialise(sfs_data(panel, counts, c))
    data = M.jackknife(base, c.jackknife) if c.jackknife else base
    ks = data.select("rg").distinct().collect(), data.select("sfs").distinct().collect()  # read groups and classes are few
    one = M.SfsParams({r[0]: c.cont0 for r in ks[0]}, {r[0]: c.tau0 for r in ks[1]}, {r[0]: c.f0 for r in ks[1]}, c.e0, c.b0)
    fits, _ = M.fit_sfs(data, {str(k): replace(one, cont=dict(one.cont), tau=dict(one.tau), f=dict(one.f)) for k in range(c.jackknife + 1)}, c.updates, c.max_iter, c.ll_tol, calls=c.gt_mode, random_read=c.random_read)
    spark, full, one = panel.sparkSession, M.to_frame(fits), {"0": fits["0"]}
    full = full[full["rep"] == "0"].drop(columns="rep")
    full = full.assign(se=M.standard_errors(fits) if c.jackknife else None)
    rows = [*full[["parameter", "name", "value", "se"]].itertuples(index=False, name=None), *[(*x, None) for x in M.convergence_rows(fits)]]
    pars = spark.createDataFrame(rows, "parameter string, name string, value double, se double")
    own, sites = base.where("rep = '0'"), sfs_sites(panel, c)
    out = {"pars": pars, "sfs": M.call_table(own, one, c.random_read) if c.gt_mode else M.sfs_table(own, one)}
    for p in ("tau", "f"):
        e = pars.where(F.col("parameter") == p).select(F.col("name").cast("int").alias("sfs"), F.col("se").alias(f"se_{p}"))
        out["sfs"] = out["sfs"].join(e, "sfs", "left")
        if p == "tau":
            lo, hi = interval(F.col("tau"), F.col("se_tau"))
            out["sfs"] = out["sfs"].withColumns({"l_tau": lo, "h_tau": hi})
    lo, hi = interval(F.col("cont"), F.col("se_cont"))
    n = own.groupBy("rg").agg(F.sum(F.col("ref") + F.col("alt")).alias("n_reads"))
    out["cont"] = pars.where("parameter = 'cont'").select(F.col("name").alias("rg"), F.col("value").alias("cont"), F.col("se").alias("se_cont")).join(n, "rg", "left").withColumn("l_cont", lo).withColumn("h_cont", hi)
    post = M.call_posteriors(own, one, c.random_read) if c.gt_mode else M.site_posteriors(own, one)
    out["snp"] = M.site_table(sites.select("snp", "chrom", "pos", "map", "ref", "alt", "flipped"), own, post)
    every = FS.class_freqs(M.class_table(sites, data, fits, list(c.states)), list(c.states))
    pi = FS.pi_table(every, list(c.states))
    for name, f in (("f2", FS.f2), ("f3", FS.f3), ("f4", FS.f4)):
        out[name] = f(pi, [*c.states, "target"])
    out["vcf"] = out["snp"].select(
        "chrom", "pos", "ref", "alt", F.when(F.col("flipped"), F.col("alt")).otherwise(F.col("ref")).alias("aa"), *[F.col(f"log_g{g}").alias(f"l{g}") for g in range(3)],
        *[F.pow(F.lit(10.0), F.col(f"log_g{2 - g}" )).alias(f"x{g}") for g in range(3)], "flipped", (F.col("tref") + F.col("talt")).alias("depth"),
    )
    # genotypes count derived alleles; a VCF counts alternative ones
    turn = {f"l{g}": F.when(F.col("flipped"), F.col(f"l{2 - g}")).otherwise(F.col(f"l{g}")) for g in range(3)}
    out["vcf"] = out["vcf"].withColumns({**turn, **{f"g{g}": F.when(F.col("flipped"), F.col(f"x{g}")).otherwise(F.col(f"x{2 - g}")) for g in range(3)}}).drop("x0", "x1", "x2", "flipped")
    return {k: v for k, v in out.items() if k in c.outputs}


def write_sfs(tables: Mapping[str, DataFrame], path: str, fmt: str = "csv", sample: str = "target") -> None:
    for name, df in tables.items():
        if name == "vcf":
            write_vcf(df, f"{path}.vcf", [sample])
        else:
            write_table(df, f"{path}.{name}", fmt)
