"""The range coder of `range_coder`, byte for byte, as functions of the JVM that Spark's tasks call.

One id after the other takes a loop some tenth of a microsecond, and numpy forty times that. The class is compiled by
Janino, which Spark brings for its own code, and goes to the executors as a jar, as `ADD JAR` does with any other.
"""

import os
import tempfile
import zipfile
import zlib
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import range_coder

_SOURCE = r"""
package millwright;

public class NAME implements org.apache.spark.sql.api.java.UDF1 {
    static final String SQUASH = "SQUASHED";
    static final String STRETCH = "STRETCHED";
    static final int[] squash = new int[4095];
    static final int[] stretch = new int[4096];
    static {
        for (int i = 0; i < 4095; i++) squash[i] = SQUASH.charAt(i) - PLAIN;
        for (int i = 0; i < 4096; i++) stretch[i] = STRETCH.charAt(i) - PLAIN - 2047;
    }

    static final long MASK = 0xFFFFFFFFL;
    final boolean decodes;

    public NAME(boolean decodes) {
        this.decodes = decodes;
    }

    // magic, ids, pieces, bytes of code, crc32 of ids, crc32 of all that follows, pieces, code
    public Object call(Object value) {
        if (value == null) return null;
        byte[] frame = (byte[]) value;
        if (frame.length < HEAD) throw new IllegalArgumentException("a frame is damaged");
        long ids = number(frame, 4) & MASK, start = HEAD + (number(frame, 8) & MASK) * PIECE, size = number(frame, 12) & MASK;
        if (number(frame, 0) != MAGIC || start + size != frame.length || ids > 1 << 24 || number(frame, 20) != checksum(frame))
            throw new IllegalArgumentException("a frame is damaged");
        Coder coder = new Coder((int) ids);
        byte[] body = decodes ? coder.decode(frame, (int) start) : coder.encode(frame, (int) start);
        byte[] found = java.util.Arrays.copyOf(frame, (int) start + body.length);
        System.arraycopy(body, 0, found, (int) start, body.length);
        put(found, 12, body.length);
        put(found, 20, checksum(found));
        return found;
    }

    static int checksum(byte[] frame) {
        java.util.zip.CRC32 crc = new java.util.zip.CRC32();
        crc.update(frame, HEAD, frame.length - HEAD);
        return (int) crc.getValue();
    }

    static int number(byte[] data, int at) {
        return data[at] & 255 | (data[at + 1] & 255) << 8 | (data[at + 2] & 255) << 16 | (data[at + 3] & 255) << 24;
    }

    static void put(byte[] data, int at, int value) {
        for (int i = 0; i < 4; i++) data[at + i] = (byte) (value >> 8 * i);
    }

    static class Coder {
        final int n;
        long low = 0, range = MASK, code = 0;
        byte[] data;
        int at;

        final int[][] guess = new int[2][TABLE];
        final byte[][] record = new byte[2][TABLE];
        // of a prediction: track records by state, then weights
        final int[][] seconds = new int[2][SURE + 1], firsts = new int[2][SURE + 1];
        final long[] secondWeights = new long[] {1 << 15, 1 << 15, 1 << 15}, firstWeights = new long[] {1 << 15, 1 << 15, 1 << 15};
        int chance, one, two;
        final int[] high = new int[256], highSums = new int[16];
        final short[] lower = new short[65536], lowerSums = new short[4096];
        int total = 256;

        Coder(int n) {
            this.n = n;
            java.util.Arrays.fill(guess[0], -1);
            java.util.Arrays.fill(guess[1], -1);
            for (int state = 0; state <= SURE; state++) {
                int start = (state + 1) * 4096 / (SURE + 3);
                seconds[0][state] = seconds[1][state] = firsts[0][state] = firsts[1][state] = start;
            }
            java.util.Arrays.fill(high, 1);
            java.util.Arrays.fill(highSums, 16);
            java.util.Arrays.fill(lower, (short) 1);
            java.util.Arrays.fill(lowerSums, (short) 16);
        }

        int mixed(int[][] records, long[] weights, int first, int other) {
            one = stretch[records[0][first]];
            two = stretch[records[1][other]];
            long sum = (weights[0] * one + weights[1] * two + weights[2] * 64) >> 16;
            chance = squash[(int) Math.max(-2047, Math.min(2047, sum)) + 2047];
            return chance;
        }

        void learn(int[][] records, long[] weights, int first, int other, boolean hit) {
            int error = (hit ? 4096 : 0) - chance, to = hit ? 4095 : 0;
            weights[0] += (one * error) >> 10;
            weights[1] += (two * error) >> 10;
            weights[2] += (64 * error) >> 10;
            records[0][first] += (to - records[0][first]) >> 4;
            records[1][other] += (to - records[1][other]) >> 4;
        }

        void narrow(long unit, long below, long width, boolean reads) {
            long l = (low + below * unit) & MASK, s = (width * unit) & MASK;
            while (true) {
                if ((l ^ ((l + s) & MASK)) >= 1 << 24) {
                    if (s >= 1 << 16) break;
                    s = -l & 0xFFFF;
                }
                if (reads) {
                    code = (code << 8 | (at < data.length ? data[at] & 255 : 0)) & MASK;
                    at++;
                } else {
                    if (at == data.length) data = java.util.Arrays.copyOf(data, 2 * at);
                    data[at++] = (byte) (l >> 24);
                }
                l = l << 8 & MASK;
                s = s << 8 & MASK;
            }
            low = l;
            range = s;
        }

        boolean bit(boolean reads, boolean hit) {
            long unit = range >> 12;
            if (reads) hit = ((code - low) & MASK) < chance * unit;
            narrow(unit, hit ? 0 : chance, hit ? chance : 4096 - chance, reads);
            return hit;
        }

        // high bytes; value is not used in reading
        int upper(boolean reads, int value) {
            long unit = range / total;
            int below = 0;
            if (reads) {
                int place = (int) Math.min(((code - low) & MASK) / unit, total - 1), group = 0;
                while (below + highSums[group] <= place) below += highSums[group++];
                value = group << 4;
                while (below + high[value] <= place) below += high[value++];
            } else {
                for (int group = 0; group < value >> 4; group++) below += highSums[group];
                for (int i = value & 0xF0; i < value; i++) below += high[i];
            }
            narrow(unit, below, high[value], reads);
            high[value] += 32;
            highSums[value >> 4] += 32;
            total += 32;
            if (total > MOST) {
                total = 0;
                for (int group = 0; group < 16; group++) {
                    int sum = 0;
                    for (int i = group << 4; i < (group + 1) << 4; i++) sum += high[i] = high[i] >> 1 | 1;
                    total += highSums[group] = sum;
                }
            }
            return value;
        }

        // low bytes after the high one
        int lower(boolean reads, int upper, int value) {
            int base = upper << 8, sums = upper << 4, all = 0, below = 0;
            for (int group = 0; group < 16; group++) all += lowerSums[sums + group];
            long unit = range / all;
            if (reads) {
                int place = (int) Math.min(((code - low) & MASK) / unit, all - 1), group = 0;
                while (below + lowerSums[sums + group] <= place) below += lowerSums[sums + group++];
                value = group << 4;
                while (below + lower[base + value] <= place) below += lower[base + value++];
            } else {
                for (int group = 0; group < value >> 4; group++) below += lowerSums[sums + group];
                for (int i = value & 0xF0; i < value; i++) below += lower[base + i];
            }
            narrow(unit, below, lower[base + value], reads);
            lower[base + value] += 24;
            lowerSums[sums + (value >> 4)] += 24;
            if (lower[base + value] > 220) {
                for (int group = 0; group < 16; group++) {
                    int sum = 0;
                    for (int i = base + (group << 4); i < base + ((group + 1) << 4); i++) {
                        lower[i] = (short) (lower[i] >> 1 | 1);
                        sum += lower[i];
                    }
                    lowerSums[sums + group] = (short) sum;
                }
            }
            return value;
        }

        // an id, or where reading the next one; now is not used in reading
        int step(boolean reads, int now, int slot0, int slot1) {
            int guess0 = guess[0][slot0], guess1 = guess[1][slot1], trust0 = record[0][slot0], trust1 = record[1][slot1];
            boolean same = guess0 == guess1;
            int agree = same ? trust0 : 0, value;
            mixed(seconds, secondWeights, trust1, agree);
            boolean hit = bit(reads, guess1 == now);
            learn(seconds, secondWeights, trust1, agree, hit);
            value = guess1;
            if (!hit && !same) {
                mixed(firsts, firstWeights, trust0, trust1);
                hit = bit(reads, guess0 == now);
                learn(firsts, firstWeights, trust0, trust1, hit);
                value = guess0;
            }
            if (!hit) {
                int up = upper(reads, now >> 8);
                value = up << 8 | lower(reads, up, now & 255);
            }
            if (guess0 != value && trust0 == 0) guess[0][slot0] = value;
            if (guess1 != value && trust1 == 0) guess[1][slot1] = value;
            record[0][slot0] = (byte) (guess0 == value ? Math.min(trust0 + 1, SURE) : trust0 >> 1);
            record[1][slot1] = (byte) (guess1 == value ? Math.min(trust1 + 1, SURE) : trust1 >> 1);
            return value;
        }

        byte[] encode(byte[] frame, int start) {
            data = new byte[2 * n + 64];
            run(false, frame, start);
            if (data.length < at + 4) data = java.util.Arrays.copyOf(data, at + 4);
            for (int i = 0; i < 4; i++) {
                data[at++] = (byte) (low >> 24);
                low = low << 8 & MASK;
            }
            return java.util.Arrays.copyOf(data, at);
        }

        byte[] decode(byte[] frame, int start) {
            data = frame;
            for (at = start; at < start + 4; at++) code = code << 8 | (at < data.length ? data[at] & 255 : 0);
            byte[] ids = new byte[2 * n];
            run(true, ids, 0);
            return ids;
        }

        void run(boolean reads, byte[] ids, int first) {
            long last = 0, before = 0;
            for (int i = first; i < first + 2 * n; i += 2) {
                int slot0 = (int) ((last * 40503L >> 4) % TABLE), slot1 = (int) ((last * 40503L + before * 30029L >> 3) % TABLE);
                int now = step(reads, reads ? 0 : ids[i] & 255 | (ids[i + 1] & 255) << 8, slot0, slot1);
                if (reads) {
                    ids[i] = (byte) now;
                    ids[i + 1] = (byte) (now >> 8);
                }
                before = last;
                last = now;
            }
        }
    }
}
"""


@cache
def _source(head: int, piece: int, magic: int) -> tuple[str, str]:
    """Name and text of the class; another text has another name."""
    text = _SOURCE  # numbers as characters of a string, from PLAIN on, where none has a meaning of its own
    for name, values in (("SQUASHED", range_coder._squash), ("STRETCHED", range_coder._stretch + 2047)):
        text = text.replace(f'"{name}"', '"' + "".join(f"\\u{value + 256:04x}" for value in values.tolist()) + '"')
    numbers = {
        "TABLE": range_coder.TABLE, "SURE": range_coder.SURE, "MOST": range_coder.MOST, "HEAD": head, "PIECE": piece, "MAGIC": magic, "PLAIN": 256,
    }
    fixed = "".join(f"    static final int {name} = {value};\n" for name, value in numbers.items())
    text = text.replace("    static final long MASK", fixed + "    static final long MASK", 1)
    name = f"RangeCoder{zlib.crc32(text.encode()):08x}"
    return name, text.replace("NAME", name)


def _jar(spark: SparkSession, name: str, source: str) -> str:
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(source)
    path = os.path.join(tempfile.mkdtemp(prefix="millwright-"), f"{name}.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for inner, code in dict(compiler.getBytecodes()).items():
            jar.writestr(inner.replace(".", "/") + ".class", bytes(code))
    return path


def _function(spark: SparkSession, kind: str, head: int, piece: int, magic: bytes) -> str:
    """Name of the function; the class is compiled, handed out and registered once in a session."""
    name, source = _source(head, piece, int.from_bytes(magic, "little"))
    function = f"{kind}_{name.lower()}"
    if spark.catalog.functionExists(function):
        return function
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    try:
        found = loader.loadClass(f"millwright.{name}")
    except Py4JJavaError:  # not handed out yet
        spark.sql(f"ADD JAR '{_jar(spark, name, source)}'")
        found = loader.loadClass(f"millwright.{name}")
    gateway = spark.sparkContext._gateway
    kinds, values = gateway.new_array(spark._jvm.java.lang.Class, 1), gateway.new_array(spark._jvm.java.lang.Object, 1)
    kinds[0], values[0] = spark._jvm.java.lang.Boolean.TYPE, kind == "decode"
    coder = found.getConstructor(kinds).newInstance(values)
    spark._jsparkSession.udf().register(function, coder, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL("binary"))
    return function


def coded(spark: SparkSession, frame: Column, head: int, piece: int, magic: bytes) -> Column:
    """A frame of token_files whose ids are plain, little-endian and of 16 bits, with their code in their place."""
    return F.call_udf(_function(spark, "encode", head, piece, magic), frame)


def plain(spark: SparkSession, frame: Column, head: int, piece: int, magic: bytes) -> Column:
    """The frame that `coded` was made of; raises if the one given is damaged."""
    return F.call_udf(_function(spark, "decode", head, piece, magic), frame)
