"""Text scan and the parsers that turn lines into a log frame."""
