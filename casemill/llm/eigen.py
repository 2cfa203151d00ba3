"""Eigenvalues and eigenvectors of a symmetric matrix of whole numbers, by its exact characteristic polynomial.

The polynomial modulo a prime comes from the matrix in Hessenberg form; as many primes as its coefficients' bound
asks are put together by Chinese remainders. All roots are real, so the number of roots above a point is the number of
sign changes of the shifted polynomial (Descartes' rule is exact there): bisection on whole numbers isolates each
distinct root with its multiplicity, to any precision. Eigenvectors are null vectors of (M - root I), by inverse
iteration in decimals with digits to spare for the least gap.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, gcd

import numpy as np

Matrix = list[list[int]]


def primes_below(top: int, n: int) -> list[int]:
    """The n largest primes below top (at most 2**31, so that products fit 64 bits)."""
    found = []
    while len(found) < n:
        low = max(2, top - 200_000)
        sieve = np.ones(top - low, bool)
        for p in range(2, int(top**0.5) + 1):
            sieve[max(p * p, -(-low // p) * p) - low :: p] = False
        found += (np.flatnonzero(sieve)[::-1] + low).tolist()
        if low == 2:
            break
        top = low
    return found[:n]


def polynomial_modulo(rows: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - rows) modulo a prime below 2**31, from the constant one on."""
    h = rows.astype(np.int64) % p
    d = len(h)
    for k in range(d - 2):  # zeros below the first subdiagonal of column k, by similar matrices
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        for j, factor in enumerate(factors.tolist(), k + 2):
            if factor:
                h[:, k + 1] = (h[:, k + 1] + h[:, j] * factor) % p
    polynomials = np.zeros((d + 1, d + 1), np.int64)
    polynomials[0, 0] = 1 % p
    for k in range(d):
        new = np.r_[0, polynomials[k, :-1]] - polynomials[k] * int(h[k, k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            new = new - polynomials[i] * (int(h[i, k]) * chain % p) % p
        polynomials[k + 1] = new % p
    return polynomials[d]


def bound(m: Matrix) -> int:
    """No coefficient of the characteristic polynomial is larger: its roots are at most the largest row sum."""
    most = max((sum(map(abs, row)) for row in m), default=0)
    return max((comb(len(m), k) * most**k for k in range(len(m) + 1)), default=1)


def primes_for(m: Matrix) -> list[int]:
    """Primes whose product is more than twice the bound."""
    return primes_below(2**31, (2 * bound(m)).bit_length() // 30 + 1)


def remainders_joined(residues: dict[int, list[int]]) -> list[int]:
    """The whole numbers (of either sign, least in size) with the given residues for each prime."""
    modulus, values = 1, []
    for p, own in residues.items():
        if not values:
            values, modulus = [v % p for v in own], p
            continue
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, own)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def shifted(poly: list[int], at: Fraction) -> list[int]:
    """A positive multiple of poly(x + at)."""
    d, a, b = len(poly) - 1, at.numerator, at.denominator
    c = [v * b ** (d - k) for k, v in enumerate(poly)]  # of x / b
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    return c


def roots_above(poly: list[int], at: Fraction) -> int:
    """How many roots, counted with multiplicity, are larger: the sign changes, as all roots are real."""
    signs = [v > 0 for v in shifted(poly, at) if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _primitive(poly: list[int]) -> list[int]:
    while poly and not poly[-1]:
        poly = poly[:-1]
    g = gcd(*poly) or 1
    return [v // g for v in poly]


def _remainder(a: list[int], b: list[int]) -> list[int]:
    a = list(a)
    while len(a) >= len(b) and any(a):
        lead, k = a[-1], len(a) - len(b)
        a = [v * b[-1] for v in a]
        for i, v in enumerate(b):
            a[i + k] -= lead * v
        a = _primitive(a)
    return a


def square_free(poly: list[int], prime: int = 2**31 - 1) -> list[int]:
    """The polynomial with each root once. A common factor with the derivative is looked for modulo a prime first."""
    slope = _primitive([k * v for k, v in enumerate(poly)][1:])
    a, b = [v % prime for v in poly], [v % prime for v in slope]
    while b and not b[-1]:
        b.pop()
    while len(b) > 1:
        inverse = pow(b[-1], -1, prime)
        while len(a) >= len(b):
            lead, k = a[-1] * inverse % prime, len(a) - len(b)
            for i, v in enumerate(b):
                a[i + k] = (a[i + k] - lead * v) % prime
            while a and not a[-1]:
                a.pop()
        a, b = b, a
    if len(b) == 1:
        return poly
    a, b = _primitive(list(poly)), slope
    while b:
        a, b = b, _primitive(_remainder(a, b))
    out, rest = [0] * (len(poly) - len(a) + 1), [Fraction(v) for v in poly]
    for k in range(len(out) - 1, -1, -1):
        out[k] = rest[k + len(a) - 1] / a[-1]
        for i, v in enumerate(a):
            rest[i + k] -= out[k] * v
    scale = 1
    for v in out:
        scale = scale * v.denominator // gcd(scale, v.denominator)
    return _primitive([int(v * scale) for v in out])


def largest_roots(poly: list[int], wanted: int, digits: int = 20) -> list[tuple[Fraction, Fraction, int]]:
    """(low, high, multiplicity) of the largest distinct positive roots, until more than `wanted` are counted (or all).

    Intervals (low, high] are apart from one another and from zero by more than 10**digits of their widths.
    """
    single = square_free(poly)
    top = Fraction(1)
    while roots_above(poly, top):
        top *= 2
    apart: list[tuple[Fraction, Fraction]] = []
    stack = [(Fraction(0), top, 0, roots_above(single, Fraction(0)))]  # low, high, distinct roots above high, above low
    counted = 0
    while stack and counted <= wanted:
        low, high, over, upto = stack.pop()
        if upto == over:
            continue
        if upto - over == 1:
            apart.append((low, high))
            counted = roots_above(poly, low)
            continue
        middle = (low + high) / 2
        at = roots_above(single, middle)
        stack += [(low, middle, at, upto), (middle, high, over, at)]
    out, before = [], 0
    ends = [low for low, _ in apart]
    for k, (low, high) in enumerate(apart):
        above = roots_above(single, high)
        upto = roots_above(poly, low)
        while True:
            gap = min([low] + [abs(low - high2) for _, high2 in apart[k + 1 : k + 2]] + [abs(ends[k - 1] - high)] * (k > 0))
            if gap and (high - low) * 10**digits < gap:
                break
            middle = (low + high) / 2
            if roots_above(single, middle) > above:
                low = middle
            else:
                high = middle
        apart[k], ends[k] = (low, high), low
        out.append((low, high, upto - before))
        before = upto
    return out


def _solved(m: np.ndarray, right: np.ndarray, tiny: Decimal) -> np.ndarray:
    """m x = right by elimination with row pivots; a zero pivot counts as tiny. Decimals throughout."""
    a = np.concatenate([m, right], axis=1)
    d = len(m)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        if not a[k, k]:
            a[k, k] = tiny
        if k + 1 < d:
            a[k + 1 :, k:] -= (a[k + 1 :, k] / a[k, k])[:, None] * a[k, k:]
    x = a[:, d:].copy()
    for k in range(d - 1, -1, -1):
        if k + 1 < d:
            x[k] = x[k] - (a[k, k + 1 : d][:, None] * x[k + 1 :]).sum(axis=0)
        x[k] = x[k] / a[k, k]
    return x


def null_vectors(m: Matrix, low: Fraction, high: Fraction, n: int, rounds: int = 2) -> tuple[Decimal, np.ndarray]:
    """The root in (low, high] as a decimal and n orthonormal eigenvectors (rows) for it."""
    width = high - low
    digits = 60 + len(str(int(high / width))) if width else 60
    with localcontext() as context:
        context.prec = digits
        middle = low + width / 2
        root = Decimal(middle.numerator) / Decimal(middle.denominator)
        own = np.array([[Decimal(v) for v in row] for row in m], object)
        own[np.arange(len(m)), np.arange(len(m))] -= root
        rng = np.random.default_rng(len(m))
        x = np.array([[Decimal(int(v)) for v in row] for row in rng.integers(1, 1000, (len(m), n))], object)
        tiny = max(abs(root), Decimal(1)).scaleb(-digits + 5)
        for _ in range(rounds):
            x = _solved(own, x, tiny)
            for _ in range(2):  # twice: the vectors of one root may come out nearly parallel
                for k in range(n):
                    for j in range(k):
                        x[:, k] = x[:, k] - x[:, j] * (x[:, j] * x[:, k]).sum()
                    x[:, k] = x[:, k] / (x[:, k] * x[:, k]).sum().sqrt()
        return root, x.T


def leading(m: Matrix, poly: list[int], wanted: int) -> list[tuple[Decimal, np.ndarray]]:
    """The `wanted` largest positive eigenvalues (fewer, if there are fewer) with unit eigenvectors, all orthogonal."""
    out: list[tuple[Decimal, np.ndarray]] = []
    for low, high, many in largest_roots(poly, wanted):
        if len(out) >= wanted:
            break
        root, vectors = null_vectors(m, low, high, many)
        out += [(root, v) for v in vectors]
    return out[:wanted]
