"""Where stores are kept."""
