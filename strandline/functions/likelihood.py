"""Probability kernels as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_FACTORIAL = [math.lgamma(i + 1) for i in range(256)]
FLOOR = 1e-250


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def safe_ln(p: Column) -> Column:
    return F.ln(F.greatest(p, F.lit(FLOOR)))


def log_factorial(n: Column) -> Column:
    """ln n! for any n ≥ 0: from a table, above it by Stirling's series, whose next term is below 1e-15."""
    top = len(LOG_FACTORIAL) - 1
    x = F.greatest(n, F.lit(top)).cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n > top, series).otherwise(F.element_at(F.array(*[F.lit(v) for v in LOG_FACTORIAL]), (F.when(n > top, top).otherwise(n) + 1).cast("int")))


def log_choose(n: Column, k: Column) -> Column:
    """ln of the binomial coefficient for 0 ≤ k ≤ n."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def read_allele_prob(g: int, p_cont: Column, cont, error) -> Column:
    """Chance that a read shows the alternative allele at genotype g, with contamination and symmetric error."""
    p = _d(cont) * p_cont + (1 - _d(cont)) * F.lit(g / 2)
    return p * (1 - _d(error)) + (1 - p) * _d(error)


def read_likelihood(g: int, alt: Column, n: Column, p_cont: Column, cont, error) -> Column:
    """P(alt reads of n | genotype g): binomial."""
    return F.exp(log_read_likelihood(g, alt, n, p_cont, cont, error))


def log_read_likelihood(g: int, alt: Column, n: Column, p_cont: Column, cont, error) -> Column:
    p = read_allele_prob(g, p_cont, cont, error)
    return log_choose(n, alt) + alt * safe_ln(p) + (n - alt) * safe_ln(1 - p)


def call_likelihood(g: int, alt: Column, n: Column, error) -> Column:
    """P(called genotype | genotype g) for called genotypes: 1 − 2e where they agree, e elsewhere."""
    return F.when(alt * 2 == n * g, 1 - 2 * _d(error)).otherwise(_d(error))


def genotype_homozygous(a: Column, b: Column, f, tau) -> tuple[Column, Column, Column]:
    """P(genotype | both haplotypes from one source) with source counts a (alt), b (ref), inbreeding f and drift tau."""
    f, tau = _d(f), _d(tau)
    d = (a + b) * (tau * (a + b) + 1)
    g0 = (b * b * tau + b + a * b * f * tau) / d
    g2 = (a * a * tau + a + a * b * f * tau) / d
    return g0, 1 - g0 - g2, g2


def genotype_heterozygous(a1: Column, b1: Column, a2: Column, b2: Column) -> tuple[Column, Column, Column]:
    d = (a1 + b1) * (a2 + b2)
    g0, g2 = b1 * b2 / d, a1 * a2 / d
    return g0, 1 - g0 - g2, g2


def genotype_haploid(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return b / (a + b), F.lit(0.0), a / (a + b)


def sfs_genotype_prior(tau, f) -> tuple[Column, Column, Column]:
    """P(ancestral, heterozygous, derived) of a site class with derived share tau and inbreeding f."""
    t, f = _d(tau), _d(f)
    return f * (1 - t) + (1 - f) * (1 - t) * (1 - t), 2 * (1 - f) * t * (1 - t), f * t + (1 - f) * t * t


def read_given_allele(is_alt: Column, flipped: Column, e, b) -> tuple[Column, Column]:
    """P(read | ancestral), P(read | derived): e is an error away from the reference allele, b one towards it.

    ``flipped`` sites have the derived allele as reference. A read shows the derived allele when is_alt != flipped.
    """
    e, b = _d(e), _d(b)
    shows_alt = is_alt == 1
    from_ref = F.when(shows_alt, e).otherwise(1 - e)  # the true allele is the reference one
    from_alt = F.when(shows_alt, 1 - b).otherwise(b)
    return F.when(flipped, from_alt).otherwise(from_ref), F.when(flipped, from_ref).otherwise(from_alt)


def call_given_genotype(alt: Column, flipped: Column, e, b) -> tuple[Column, Column, Column]:
    """P(called 0, 1 or 2 alternative alleles | genotype ancestral, heterozygous, derived)."""
    e, b = _d(e), _d(b)
    ref_hom = F.when(alt == 0, 1 - 2 * e).otherwise(e)
    het = F.when(alt == 0, b).when(alt == 1, 1 - b - e).otherwise(e)
    alt_hom = F.when(alt == 2, 1 - 2 * b).otherwise(b)
    return F.when(flipped, alt_hom).otherwise(ref_hom), het, F.when(flipped, ref_hom).otherwise(alt_hom)


def random_call_given_genotype(alt: Column, flipped: Column, e, b) -> tuple[Column, Column, Column]:
    """The same for pseudo-haploid calls, each from one random read."""
    e, b = _d(e), _d(b)
    ref_hom = F.when(alt == 0, 1 - e).otherwise(e)
    alt_hom = F.when(alt == 0, b).otherwise(1 - b)
    return F.when(flipped, alt_hom).otherwise(ref_hom), F.lit(0.5), F.when(flipped, ref_hom).otherwise(alt_hom)


def read_given_genotype(p_anc: Column, p_der: Column, psi: Column, cont: Column) -> tuple[Column, Column, Column]:
    """P(read | genotype) of a mixture: with chance ``cont`` the allele comes from a contaminant of derived frequency psi."""
    c = cont * ((1 - psi) * p_anc + psi * p_der)
    return c + (1 - cont) * p_anc, c + (1 - cont) * (p_anc + p_der) / 2, c + (1 - cont) * p_der


def normalise(parts: tuple[Column, ...]) -> tuple[Column, ...]:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return tuple(p / F.nullif(total, F.lit(0.0)) for p in parts)


def derived_freq(g: tuple[Column, Column, Column]) -> Column:
    return g[1] / 2 + g[2]


def truncated_exponential(x: Column, rate, trunc) -> Column:
    """Log density of lengths above ``trunc``; null below it."""
    return F.when(x >= _d(trunc), F.ln(_d(rate)) - _d(rate) * (x - _d(trunc)))


def truncated_lomax(x: Column, scale, shape, trunc) -> Column:
    """Log density of a Lomax law above ``trunc``; null below it."""
    s, k, t = _d(scale), _d(shape), _d(trunc)
    return F.when(x >= t, F.ln(k / s) - (k + 1) * F.ln(1 + x / s) + k * F.ln(1 + t / s))


def admixture_generations(mean_length_cm: Column, m) -> Column:
    """Generations since admixture from the mean length of tracts of a source with share m."""
    return 100 / F.nullif(mean_length_cm, F.lit(0.0)) / (1 - _d(m))
