"""episodeflow: Spark-native jobs over agent-episode data.

Everything is expressed with DataFrame / SQL / Structured Streaming
operators so that Catalyst plans the work and every step runs distributed.
"""

__version__ = "0.1.0"
