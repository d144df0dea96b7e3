"""lumispec: a Spark-first engine for collections of one-dimensional spectra."""
