"""Column functions.  All are JVM-side expressions unless the name is listed in ``functions.python_udfs``."""
