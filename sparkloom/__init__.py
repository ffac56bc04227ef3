"""sparkloom: an analytics engine written as PySpark DataFrame plans."""
