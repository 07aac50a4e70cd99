"""Sessions for local use, and shipping this package to Python workers."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}
_local_files: dict[str, str] = {}

#: Hadoop's plain local file system, but permissions are set by the JVM itself.
_PLAIN = "org.apache.hadoop.fs.RawLocalFileSystem"
_SOURCE = """
package quittance;

public class LocalFiles extends org.apache.hadoop.fs.RawLocalFileSystem {
    public void setPermission(org.apache.hadoop.fs.Path path, org.apache.hadoop.fs.permission.FsPermission permission) throws java.io.IOException {
        java.nio.file.Files.setAttribute(pathToFile(path).toPath(), "unix:mode", Integer.valueOf(permission.toShort()), new java.nio.file.LinkOption[0]);
    }
}
"""


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings a session of their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("quittance")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own, as
    all its tasks run on one machine; a cluster gets an error, as its machines share no folder that could be guessed."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='quittance-')}"
        found = _own[context.applicationId]
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per application; Spark's file server carries it."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    folder = tempfile.mkdtemp()
    target = os.path.join(folder, "quittance_package.zip")
    Path(target).write_bytes(out.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(key)


def local_files(spark: SparkSession) -> str:
    """The class of a local file system that starts no process, on the driver and all executors; compiled by Spark's own compiler
    and handed out once per application, by Spark's file server. Where the driver's class loader takes no classes, Hadoop's own."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    key = context.applicationId
    if key not in _local_files:
        loader = context._jsc.hadoopConfiguration().getClassLoader()
        try:
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(loader)
            compiler.cook(_SOURCE)
            target = os.path.join(tempfile.mkdtemp(), "quittance_local_files.jar")
            with zipfile.ZipFile(target, "w") as z:
                for name, code in compiler.getBytecodes().items():
                    z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
            loader.addURL(jvm.java.io.File(target).toURI().toURL())
            context._jsc.addJar(target)
            _local_files[key] = "quittance.LocalFiles"
        except (Py4JError, TypeError):  # a name that the JVM doesn't have is a package, which can't be called
            _local_files[key] = _PLAIN
    return _local_files[key]


def give_back(spark: SparkSession) -> bool:
    """Hands memory that the driver's JVM has freed outside its heap back to the system; its allocator keeps it otherwise, after
    much compiling some 200 MB. False where the JVM has no command for it (before 17.0.9, or not on glibc)."""
    jvm = spark.sparkContext._jvm
    try:
        # the server's own class is not open to Py4J, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        told = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        told[0], told[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), told)
    except Py4JError:
        return False
    return True
