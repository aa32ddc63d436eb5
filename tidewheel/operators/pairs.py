"""Loops over pairs that arrays are too slow for, as a function of the JVM: MD5 of 1,024 short texts a round, and sums of Gaussians.

The source is compiled by Janino, which Spark itself compiles its plans with, and goes to the executors as a jar. Its loops are over plain arrays, so
that the JVM makes vector instructions of them. Where the session has no JVM to reach, `function` gives None and callers use arrays.
"""

from __future__ import annotations

import os
import tempfile
import warnings
import zipfile

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import digests

#: Words of an MD5 block that a row's text may touch.
TOUCHED = 4

_MIX = ["d[i] ^ (b[i] & (c[i] ^ d[i]))", "c[i] ^ (d[i] & (b[i] ^ c[i]))", "b[i] ^ c[i] ^ d[i]", "c[i] ^ (b[i] | ~d[i])"]
_ONE = ["d ^ (b & (c ^ d))", "c ^ (d & (b ^ c))", "b ^ c ^ d", "c ^ (b | ~d)"]
_KINDS = [(r, k, s) for r in range(4) for k, s in enumerate(digests._S[r])]
_HEX = lambda xs: ", ".join(f"0x{x:08x}" for x in xs)

SOURCE = """
package tidewheel;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;

public class Pairs implements org.apache.spark.sql.api.java.UDF1 {
    static final int N = 1024;
    static final int[] K = {%(K)s}, G = {%(G)s}, S = {%(S)s}, START = {%(START)s};

    public Object call(Object x) throws Exception {
        if (x == null) return null;
        ByteBuffer b = ByteBuffer.wrap((byte[]) x).order(ByteOrder.LITTLE_ENDIAN);
        return b.getInt() == 0 ? race(b) : gauss(b);
    }

    static int[] ints(ByteBuffer b) { int[] a = new int[b.getInt() / 4]; b.asIntBuffer().get(a); b.position(b.position() + 4 * a.length); return a; }
    static long[] longs(ByteBuffer b) { long[] a = new long[b.getInt() / 8]; b.asLongBuffer().get(a); b.position(b.position() + 8 * a.length); return a; }
    static float[] floats(ByteBuffer b) { float[] a = new float[b.getInt() / 4]; b.asFloatBuffer().get(a); b.position(b.position() + 4 * a.length); return a; }
    static double[] doubles(ByteBuffer b) { double[] a = new double[b.getInt() / 8]; b.asDoubleBuffer().get(a); b.position(b.position() + 8 * a.length); return a; }

%(ROUNDS)s

    /* Rounds k0 .. 60 over n texts: s is the state, w the words k0 .. k0 + nt - 1 of the texts, m the rest of all words. */
    static void rounds(int[][] s, int[][] w, int[] m, int o, int k0, int nt, int n) {
        for (int i = k0; i < 61; i++) {
            int g = G[i], k = K[i] + m[o + g], kind = (i >> 4) * 4 + (i & 3);
            int[] a = s[-i & 3], b = s[(1 - i) & 3], c = s[(2 - i) & 3], d = s[(3 - i) & 3];
            if (g >= k0 && g < k0 + nt) {
                int[] x = w[g - k0];
                switch (kind) { %(WITH)s }
            } else {
                switch (kind) { %(WITHOUT)s }
            }
        }
    }

    /* Rounds from .. to - 1 of one text. */
    static void one(int[] s, int[] words, int from, int to) {
        int a = s[0], b = s[1], c = s[2], d = s[3];
        for (int i = from; i < to; i++) {
            int f = i < 16 ? %(F0)s : i < 32 ? %(F1)s : i < 48 ? %(F2)s : %(F3)s;
            int x = a + f + K[i] + words[G[i]];
            a = d; d = c; c = b; b = b + Integer.rotateLeft(x, S[(i >> 4) * 4 + (i & 3)]);
        }
        s[0] = a; s[1] = b; s[2] = c; s[3] = d;
    }

    int n, nq, ns, ng, nl;
    int[] ps, qs;
    double[] base, other, pg, qg, cg, pl, ql, cl, over;

    double weight(int q, int p) {
        double w = base[p], e = 0, l = 0;
        for (int k = 0; k < ns; k++) if (ps[k * n + p] != qs[q * ns + k]) w *= other[k];
        for (int k = 0; k < ng; k++) { double d = pg[k * n + p] - qg[q * ng + k]; e += cg[k] * (d * d); }
        w *= Math.exp(-e);
        if (nl > 0 && over[q] > 0) {
            for (int k = 0; k < nl; k++) { double d = pl[k * n + p] - ql[q * nl + k]; l += cl[k] * (d * d); }
            if (l == l) w *= Math.exp(-l) / over[q];
        }
        return w;
    }

    static byte[] race(ByteBuffer b) {
        Pairs t = new Pairs();
        int[] h = ints(b);
        int k0 = h[0], nt = h[1];
        t.n = h[2]; t.nq = h[3]; t.ns = h[4]; t.ng = h[5]; t.nl = h[6];
        int n = t.n, nq = t.nq;
        int[][] w = new int[nt][];
        for (int k = 0; k < nt; k++) w[k] = ints(b);
        int[] m = ints(b), upto = ints(b);
        float[] inv = floats(b);
        t.base = doubles(b); t.ps = ints(b); t.qs = ints(b); t.other = doubles(b); t.pg = doubles(b); t.qg = doubles(b); t.cg = doubles(b);
        t.pl = doubles(b); t.ql = doubles(b); t.cl = doubles(b); t.over = doubles(b);
        long[] ids = longs(b);
        double[] best = new double[nq];
        int[] at = new int[nq], begun = new int[4 * nq], words = new int[16], state = new int[4];
        float[] most = new float[nq];
        for (int q = 0; q < nq; q++) {
            best[q] = Double.POSITIVE_INFINITY; at[q] = -1; most[q] = Float.POSITIVE_INFINITY;
            System.arraycopy(m, 16 * q, words, 0, 16);
            System.arraycopy(START, 0, state, 0, 4);
            one(state, words, 0, k0);
            System.arraycopy(state, 0, begun, 4 * q, 4);
        }
        int[][] s = new int[4][N], c = new int[nt][N];
        int[] hit = new int[N];
        float[] ci = new float[N];
        for (int j = 0, len; j < n; j += len) {
            len = Math.min(j == 0 ? N / 8 : N, n - j); // the first rows all have to be weighed: there is no key yet
            for (int k = 0; k < nt; k++) System.arraycopy(w[k], j, c[k], 0, len);
            System.arraycopy(inv, j, ci, 0, len);
            for (int q = 0; q < nq; q++) {
                int to = Math.min(len, upto[q] - j);
                if (to <= 0) continue;
                for (int k = 0; k < 4; k++) java.util.Arrays.fill(s[(k - k0) & 3], 0, to, begun[4 * q + k]);
                rounds(s, c, m, 16 * q, k0, nt, to);
                int hits = found(s[0], ci, most[q], to, hit);
                for (int x = 0; x < hits; x++) {
                    int i = hit[x], p = j + i;
                    long first = Integer.reverseBytes(s[0][i] + START[0]) & 0xffffffffL;
                    double v = t.weight(q, p);
                    if (!(v > 0) || v == Double.POSITIVE_INFINITY || first * (1 - 1e-6) / 4294967296.0 / v > best[q]) continue;
                    for (int k = 0; k < 16; k++) words[k] = m[16 * q + k] + (k >= k0 && k < k0 + nt ? c[k - k0][i] : 0);
                    System.arraycopy(START, 0, state, 0, 4);
                    one(state, words, 0, 64);
                    long u = first << 20 | (Integer.reverseBytes(state[1] + START[1]) & 0xffffffffL) >>> 12;
                    double key = -Math.log(1 - u / 4503599627370496.0) / v;
                    if (at[q] < 0 || key < best[q] || key == best[q] && ids[p] < ids[at[q]]) {
                        best[q] = key; at[q] = p;
                        double more = nOr(t.over, q, t.nl);
                        most[q] = (float) Math.max(1e-30, key * more * 2147483648.0 * (1 + 1e-5));
                    }
                }
            }
        }
        ByteBuffer out = ByteBuffer.allocate(12 * nq).order(ByteOrder.LITTLE_ENDIAN);
        for (int q = 0; q < nq; q++) out.putDouble(best[q]);
        for (int q = 0; q < nq; q++) out.putInt(at[q]);
        return out.array();
    }

    /* What a weight may be above its row's bound. */
    static double nOr(double[] over, int q, int nl) { return nl > 0 && over[q] > 0 ? Math.max(1, 1 / over[q]) : 1; }

    /* The places whose first word, over the bound of the weight, is not above `most`; -ln(1 - u) is not below u. */
    static int found(int[] word, float[] inv, float most, int n, int[] hit) {
        int hits = 0, start = START[0];
        for (int i = 0; i < n; i++) if ((Integer.reverseBytes(word[i] + start) >>> 1) * inv[i] <= most) hit[hits++] = i;
        return hits;
    }

    static void less(double[] e, double[] p, int at, double q, double c, int n) { for (int i = 0; i < n; i++) { double d = p[at + i] - q; e[i] -= c * (d * d); } }
    static void low(double[] e, double[] y, int n) { for (int i = 0; i < n; i++) { double x = e[i]; y[i] = 1 + x * (1 + x * (0.5 + x * (%(C3)s + x * (%(C4)s + x * %(C5)s)))); } }
    static void high(double[] e, double[] y, int n) { for (int i = 0; i < n; i++) { double x = e[i]; double z = x * x * x; y[i] += z * z * (%(C6)s + x * (%(C7)s + x * (%(C8)s + x * (%(C9)s + x * %(C10)s)))); } }
    static void squared(double[] y, int n) { for (int i = 0; i < n; i++) { double x = y[i] * y[i]; x = x * x; y[i] = x * x; } }

    /* For each request, the sum over rows 0 .. upto - 1 of exp(-sum of c (p - q)^2): a series at 1/512 of the exponent, squared nine times. */
    static byte[] gauss(ByteBuffer b) {
        int[] h = ints(b), upto = ints(b);
        int n = h[0], nq = h[1], nl = h[2];
        double[] p = doubles(b), qs = doubles(b), c = doubles(b), far = doubles(b), e = new double[N], y = new double[N], sum = new double[nq];
        for (int j = 0; j < n; j += N) {
            int len = Math.min(N, n - j);
            for (int q = 0; q < nq; q++) {
                int to = Math.min(len, upto[q] - j);
                if (to <= 0) continue;
                boolean near = far[q] < 300;
                java.util.Arrays.fill(e, 0, to, 0);
                for (int k = 0; k < nl; k++) less(e, p, k * n + j, qs[q * nl + k], near ? c[k] / 512 : c[k], to);
                if (near) { low(e, y, to); high(e, y, to); squared(y, to); squared(y, to); squared(y, to); }
                else for (int i = 0; i < to; i++) y[i] = Math.exp(e[i]);
                double s0 = 0, s1 = 0, s2 = 0, s3 = 0;
                int i = 0;
                for (; i + 4 <= to; i += 4) { s0 += y[i]; s1 += y[i + 1]; s2 += y[i + 2]; s3 += y[i + 3]; }
                for (; i < to; i++) s0 += y[i];
                sum[q] += s0 + s1 + s2 + s3;
            }
        }
        ByteBuffer out = ByteBuffer.allocate(8 * nq).order(ByteOrder.LITTLE_ENDIAN);
        for (int q = 0; q < nq; q++) out.putDouble(sum[q]);
        return out.array();
    }
}
""" % {
    "K": _HEX(digests._K),
    "G": ", ".join(map(str, digests._G)),
    "S": ", ".join(str(s) for _, _, s in _KINDS),
    "START": _HEX(digests._START),
    "ROUNDS": "\n".join(
        f"    static void {name}{r}{k}(int[] a, int[] b, int[] c, int[] d, {'int[] w, ' if more else ''}int k, int n) {{ for (int i = 0; i < n; i++) {{ int x = a[i] + ({_MIX[r]}) {more}+ k; a[i] = ((x << {s}) | (x >>> {32 - s})) + b[i]; }} }}"
        for r, k, s in _KINDS
        for name, more in (("v", "+ w[i] "), ("k", ""))
    ),
    "WITH": " ".join(f"case {4 * r + k}: v{r}{k}(a, b, c, d, x, k, n); break;" for r, k, _ in _KINDS),
    "WITHOUT": " ".join(f"case {4 * r + k}: k{r}{k}(a, b, c, d, k, n); break;" for r, k, _ in _KINDS),
    **{f"F{r}": f"({f})" for r, f in enumerate(_ONE)},
    **{f"C{k}": repr(1.0 / f) for k, f in zip(range(3, 11), (6, 24, 120, 720, 5040, 40320, 362880, 3628800))},
}

_made: dict = {}
_NAME = "tidewheel_pairs"


def function(spark: SparkSession):
    """A function of columns: the answer to a packed task, NULL for NULL. None, with a warning, where it cannot be had."""
    try:
        sc = spark.sparkContext
        if sc.applicationId not in _made:
            compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(SOURCE)
            codes = compiler.getBytecodes()
            path = os.path.join(tempfile.mkdtemp(prefix="tidewheel-"), "tidewheel-pairs.jar")
            with zipfile.ZipFile(path, "w") as z:
                for name in list(codes):
                    z.writestr(name.replace(".", "/") + ".class", bytes(codes[name]))
            spark.sql(f"ADD JAR '{path}'")
            _made[sc.applicationId] = sc._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass("tidewheel.Pairs").newInstance()
        spark._jsparkSession.udf().register(_NAME, _made[sc.applicationId], spark._jsparkSession.parseDataType('"binary"'))
    except Exception as e:  # no JVM (Spark Connect), or one that keeps its classes closed
        warnings.warn(f"loops over pairs run in arrays, about ten times as slow: {e}", stacklevel=2)
        return None
    return lambda c: F.call_function(_NAME, c)


def pack(kind: int, *parts: np.ndarray) -> bytes:
    out = [np.int32(kind).tobytes()]
    for x in parts:
        x = np.ascontiguousarray(x)
        out += [np.int32(x.nbytes).tobytes(), x.tobytes()]
    return b"".join(out)
