"""pitchflow: match-event, player-load and document analytics as Spark DataFrame operators."""
