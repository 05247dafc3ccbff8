"""python -m strandline hmm|sfs|runs|panel|counts [options]: fits, run calling from a bin table, panels from VCF, counts from BAM."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from strandline.pipelines import PRESETS, HmmConfig, SfsConfig, run_hmm, run_sfs, write_sfs
from strandline.sources.sinks import write_table
from strandline.sources.text import COUNTS, load_panel, read_table
from strandline.states import load_populations, parse_chroms, parse_states


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("hmm", "sfs"):
        q = sub.add_parser(name)
        q.add_argument("--panel", nargs="+", required=True)
        q.add_argument("--target", required=True)
        q.add_argument("--out", required=True)
        q.add_argument("--states", nargs="+", default=["AFR", "NEA", "DEN"])
        q.add_argument("--state-file")
        q.add_argument("--cont-id", default="AFR")
        q.add_argument("--ancestral", default=None if name == "hmm" else "PAN")
        q.add_argument("--max-iter", type=int)
        q.add_argument("--ll-tol", type=float)
        q.add_argument("--format", choices=["csv", "parquet"], default="csv")
        q.add_argument("--autosomes-only", action="store_true")
        q.add_argument("--gt-mode", action="store_true")
        q.add_argument("--skip", nargs="*", default=[], help="tables that are not written")
        sex = q.add_mutually_exclusive_group()
        sex.add_argument("--male", action="store_true")
        sex.add_argument("--female", action="store_true")
        for option in ("c0", "e0", "F0", "tau0"):
            q.add_argument(f"--{option}", type=float)
        if name == "hmm":
            q.add_argument("--preset", choices=sorted(PRESETS), default=None)
            q.add_argument("--homo-states", nargs="+")
            q.add_argument("--het-states", nargs="+", help="pairs of states as A+B")
            q.add_argument("--bin-size", type=float)
            q.add_argument("--snp-mode", action="store_true")
            q.add_argument("--pos-mode", action="store_true")
            q.add_argument("--haplo-chroms", help="as 1-3,X")
            q.add_argument("--prior", type=float)
            q.add_argument("--ancestral-prior", type=float)
            q.add_argument("--filter-delta", type=float)
            q.add_argument("--filter-pos", type=float)
            q.add_argument("--filter-high-cov", type=float)
            q.add_argument("--downsample", type=float)
            q.add_argument("--fake-contamination", type=float)
            q.add_argument("--dont-est-contamination", action="store_true")
            q.add_argument("--est-error", action="store_true")
            q.add_argument("--est-F", action="store_true")
            q.add_argument("--est-tau", action="store_true")
            q.add_argument("--est-inbreeding", action="store_true")
            q.add_argument("--dont-est-trans", action="store_true")
            q.add_argument("--freq-contamination", type=int)
            q.add_argument("--freq-F", type=int)
            q.add_argument("--init-guess", nargs="*")
            q.add_argument("--transition-matrix", help="rates between sources, comma separated lines without header")
            q.add_argument("--dont-split-lib", action="store_true")
            q.add_argument("--run-penalty", type=float)
            q.add_argument("--n-post-replicates", type=int)
            q.add_argument("--seed", type=int)
        else:
            q.add_argument("--rrgt", action="store_true", help="called genotypes are of one random read each")
            q.add_argument("--b0", type=float)
            for part in ("contamination", "error", "F", "tau"):
                q.add_argument(f"--dont-est-{part}", action="store_true")
            q.add_argument("--est-bias", action="store_true")
            q.add_argument("--jk-resamples", type=int, default=0)
    q = sub.add_parser("runs")
    q.add_argument("--target-file", "--in", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--run-penalty", type=float, default=0.2)
    q.add_argument("--states", nargs="+", help="posterior columns; by default those after viterbi, n_snps and haploid")
    q.add_argument("--format", choices=["csv", "parquet"], default="csv")
    q = sub.add_parser("panel")
    q.add_argument("--vcf", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--states", nargs="*", default=[])
    q.add_argument("--state-file", required=True)
    q.add_argument("--random-read-samples", nargs="*", default=[])
    q.add_argument("--rec-file", help="recombination map; {CHROM} stands for the chromosome")
    q.add_argument("--map-id", default="AA_Map")
    q.add_argument("--rec-rate", type=float, default=1e-8)
    q.add_argument("--chroms", default="1-22,X")
    q.add_argument("--format", choices=["csv", "parquet"], default="csv")
    q = sub.add_parser("counts")
    q.add_argument("--bam", nargs="+", required=True)
    q.add_argument("--panel", nargs="+", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--exact", action="store_true", help="a row per length, damage position and damage site")
    q.add_argument("--deam-cutoff", type=int, default=3)
    q.add_argument("--length-bin-size", type=int)
    q.add_argument("--minmapq", type=int, default=25)
    q.add_argument("--min-length", type=int, default=35)
    q.add_argument("--max-reads", type=int, default=100)
    q.add_argument("--format", choices=["csv", "parquet"], default="csv")
    return p


def _given(**options) -> dict:
    return {k: v for k, v in options.items() if v is not None}


def _on(flag: bool) -> bool | None:
    return True if flag else None


def _off(flag: bool) -> bool | None:
    return False if flag else None


def hmm_config(a: argparse.Namespace, states: tuple[str, ...]) -> HmmConfig:
    """The preset or the defaults, changed only by the options that were given."""
    c = PRESETS[a.preset] if a.preset else HmmConfig()
    bin_size = None if a.bin_size is None else a.bin_size if a.pos_mode else a.bin_size * 1e-6
    if a.pos_mode and bin_size is None:
        bin_size = 10_000
    rates = tuple(tuple(float(x) for x in line.split(",")) for line in open(a.transition_matrix) if line.strip()) if a.transition_matrix else None
    het = tuple(tuple(x.split("+", 1)) for x in a.het_states) if a.het_states else None
    return replace(
        c, sources=states, cont=a.cont_id, ancestral=a.ancestral, outputs=tuple(x for x in c.outputs if x not in a.skip),
        **_given(
            by="pos" if a.pos_mode else None, bin_size=bin_size, prior=a.prior, delta=a.filter_delta, thin=a.filter_pos, high_cov=a.filter_high_cov, downsample=a.downsample, fake_contamination=a.fake_contamination, est_cont=_off(a.dont_est_contamination),
            est_error=_on(a.est_error), est_f=_on(a.est_F), est_tau=_on(a.est_tau), inbreeding=_on(a.est_inbreeding), est_trans=_off(a.dont_est_trans), split_lib=_off(a.dont_split_lib), run_penalty=a.run_penalty, replicates=a.n_post_replicates, seed=a.seed, max_iter=a.max_iter, ll_tol=a.ll_tol,
            homo=tuple(a.homo_states) if a.homo_states else None, het=het, snp_mode=_on(a.snp_mode), gt_mode=_on(a.gt_mode), sex="m" if a.male else "f" if a.female else None, haplo_chroms=tuple(parse_chroms(a.haplo_chroms)) if a.haplo_chroms else None, ancestral_prior=a.ancestral_prior,
            freq_cont=a.freq_contamination, freq_f=a.freq_F, favoured=tuple(a.init_guess) if a.init_guess else None, rates=rates, cont0=a.c0, error0=a.e0, f0=a.F0, tau0=a.tau0, autosomes=_on(a.autosomes_only),
        ),
    )


def sfs_config(a: argparse.Namespace, states: tuple[str, ...]) -> SfsConfig:
    c = SfsConfig()
    u = replace(c.updates, **_given(cont=_off(a.dont_est_contamination), error=_off(a.dont_est_error), f=_off(a.dont_est_F), tau=_off(a.dont_est_tau), bias=bool(a.est_bias)))
    return replace(
        c, states=states, cont=a.cont_id, ancestral=a.ancestral, sex="m" if a.male else "f", jackknife=a.jk_resamples, updates=u, gt_mode=a.gt_mode or a.rrgt, random_read=a.rrgt, outputs=tuple(x for x in c.outputs if x not in a.skip),
        **_given(max_iter=a.max_iter, ll_tol=a.ll_tol, cont0=a.c0, e0=a.e0, b0=a.b0, f0=a.F0, tau0=a.tau0),
    )


def call_again(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs from a table of decoded bins."""
    from strandline.operators.tracts import recall_runs

    bins = spark.read.parquet(a.target_file) if a.format == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(a.target_file)
    fixed = {"sample", "chrom", "bin", "id", "map", "pos", "viterbi", "n_snps", "haploid"}
    order = "bin" if "bin" in bins.columns else "id"
    keys = [k for k in ("sample", "chrom") if k in bins.columns]
    write_table(recall_runs(bins, a.states or [x for x in bins.columns if x not in fixed], keys, order, a.run_penalty), a.out, a.format)


def build_panel(spark: SparkSession, a: argparse.Namespace) -> None:
    """A panel from VCF files, with genetic positions from recombination maps or a constant rate."""
    from strandline.sources.text import panel_from_vcf

    pops = load_populations(a.state_file)
    pops = {k: pops.get(k, [k]) for k in a.states} if a.states else pops
    write_table(panel_from_vcf(spark, a.vcf, pops, parse_chroms(a.chroms), a.random_read_samples, a.rec_file, a.map_id, a.rec_rate), a.out, a.format)


def count_bam(spark: SparkSession, a: argparse.Namespace) -> None:
    """Read counts at panel sites from BAM files."""
    from strandline.operators.panelstats import cap_reads, read_passes
    from strandline.sources.binary import pileup, pileup_counts, pileup_counts_exact, read_bam

    sites = load_panel(spark, a.panel, {}).select("chrom", "pos", "ref", "alt")
    piles = pileup(read_bam(spark, *a.bam), sites).where(read_passes(a.min_length, 1 << 30, min_map=a.minmapq))
    piles = cap_reads(piles, ["chrom", "pos"], ["rg", "len", "pos_in_read", "base", "reverse", "bq", "mq"], a.max_reads)
    write_table(pileup_counts_exact(piles) if a.exact else pileup_counts(piles, a.deam_cutoff, a.length_bin_size), a.out, a.format)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    if a.what in ("runs", "panel", "counts"):
        {"runs": call_again, "panel": build_panel, "counts": count_bam}[a.what](spark, a)
        return
    states = parse_states(a.states, load_populations(a.state_file) if a.state_file else None)
    extra = [x for x in (a.cont_id, a.ancestral) if x and x not in states]
    panel = load_panel(spark, a.panel, states | {x: [x] for x in extra}, a.autosomes_only)
    counts = read_table(spark, a.target, COUNTS)
    if a.what == "hmm":
        run_hmm(panel, counts, hmm_config(a, tuple(states))).write(a.out, a.format)
    else:
        write_sfs(run_sfs(panel, counts, sfs_config(a, tuple(s for s in states if s not in extra))), a.out, a.format)


if __name__ == "__main__":
    main()
