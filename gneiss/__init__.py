"""gneiss: history, graph, metering and log analytics as DataFrame operators."""
