"""Functions written in Java, for loops that no expression has and that NumPy can't run fast enough."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

_classes: dict[str, object] = {}  # class loader by application


def _load(spark: SparkSession):
    """Compile java/ with Janino, which every Spark has for its own code, and send the classes to the executors (once per application)."""
    app = spark.sparkContext.applicationId
    if app not in _classes:
        jvm = spark._jvm
        sources = sorted(Path(__file__).with_name("java").glob("*.java"))
        units = spark.sparkContext._gateway.new_array(jvm.org.codehaus.commons.compiler.util.resource.Resource, len(sources))
        for i, path in enumerate(sources):
            units[i] = jvm.org.codehaus.commons.compiler.util.resource.FileResource(jvm.java.io.File(str(path)))
        compiler = jvm.org.codehaus.janino.Compiler()
        made = jvm.java.util.HashMap()
        compiler.setClassFileCreator(jvm.org.codehaus.commons.compiler.util.resource.MapResourceCreator(made))
        compiler.compile(units)
        folder = tempfile.mkdtemp(prefix="lexispark-")  # of the driver, which serves the archive
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/lexispark_java.jar", "w") as out:
            for name in sorted(made):
                out.writestr(name, bytes(made[name]))
        spark.sparkContext._jsc.addJar(f"{folder}/lexispark_java.jar")
        urls = spark.sparkContext._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(f"{folder}/lexispark_java.jar").toURI().toURL()
        _classes[app] = jvm.java.net.URLClassLoader(urls, jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    return _classes[app]


def call(name: str, returns: str, *args: Column) -> Column:
    """The Java class of that name in java/, a UDF of Spark, on the arguments."""
    spark = SparkSession.active()
    function = _load(spark).loadClass(f"lexispark.{name}").getDeclaredConstructor(None).newInstance(None)
    kind = spark._jsparkSession.parseDataType(_parse_datatype_string(returns).json())
    spark._jsparkSession.udf().register(f"lexispark_{name}", function, kind)
    return F.call_function(f"lexispark_{name}", *args)
