"""kordex: catalogue analytics and text-corpus operators, declared as Spark plans."""
