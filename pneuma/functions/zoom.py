"""Parts of a long signal's discrete Fourier transform, from pieces of the signal and for a range of bins."""

from __future__ import annotations

import numpy as np


def zoom(x: np.ndarray, n: int, first: int, bin0: int, bins: int) -> np.ndarray:
    """sum over j of x[j] * exp(-2 pi i (first + j) k / n), for k = bin0 ... bin0 + bins - 1.

    What samples first, first + 1, ... of a signal of length n add to its
    transform: sums over all pieces of the signal are the whole transform. A
    chirp turns it into one convolution of length len(x) + bins. Angles are
    taken modulo whole turns in integers, so they are exact for long signals.
    """
    j, m = np.arange(len(x), dtype=np.int64), np.arange(bins, dtype=np.int64)

    def turn(parts: np.ndarray, whole: int) -> np.ndarray:
        return np.exp(-2j * np.pi * (parts % whole) / whole)

    # j * m = (j^2 + m^2 - (m - j)^2) / 2
    size = 1 << max(1, int(len(x) + bins).bit_length())
    chirp = np.zeros(size, complex)
    chirp[:bins] = turn(-m * m, 2 * n)
    chirp[size - len(x) + 1 :] = turn(-j * j, 2 * n)[:0:-1]
    head = np.zeros(size, complex)
    head[: len(x)] = x * turn(j * (bin0 % n) % n, n) * turn(j * j, 2 * n)
    tail = np.fft.ifft(np.fft.fft(head) * np.fft.fft(chirp))[:bins]
    return tail * turn(m * m, 2 * n) * turn((bin0 + m) % n * (first % n) % n, n)


def waves(c: np.ndarray, n: int, bin0: int, first: int, length: int) -> np.ndarray:
    """Samples first ... first + length - 1 of the real signal of length n whose transform is c at bins bin0 ... and their mirrors, else 0."""
    weight = np.where((np.arange(bin0, bin0 + len(c)) * 2) % n == 0, 1.0, 2.0) / n
    return zoom(np.conj(c * weight), n, bin0, first, length).real
